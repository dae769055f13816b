"""Checked queries: GPS messages, condensation and the streaming jobs
(S2-S4, F1, A2, A8, C11, W1-W3, W5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from courierflow.operators import positions as po
from courierflow.plans.catalog import register
from courierflow.plans.oracle_views import K, oracle
from courierflow.session import scratch_path
from courierflow.sources.fixtures import tables
from courierflow.sources.messages import read_message_stream, write_message_files
from courierflow.streaming import positions as sp

# What the parser must produce from each message, computed directly from the
# events table (click = API shape with exact time, error = corrupt body,
# others = queue shape with epoch-millis time).
MSG_PARSED = ("d_msg", f"""
    SELECT event_id AS message_id, event_id // 10 AS batch_id, user_id AS courier_id,
           CASE WHEN event_type = 'click' THEN ts ELSE date_trunc('millisecond', ts) END AS ts,
           CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS delivery_id,
           CAST(-23.5505 AS DOUBLE) + value / CAST(50000.0 AS DOUBLE) AS lat,
           CAST(-46.6333 AS DOUBLE) + CAST({K} AS DOUBLE) / CAST(10000.0 AS DOUBLE) AS lon,
           CASE WHEN event_type = 'error' THEN 'unparseable body' END AS reject_reason
    FROM events""")

CONDENSED_SQL = """
    SELECT courier_id, ts, delivery_id, lat, lon
    FROM (SELECT m.*, row_number() OVER (PARTITION BY batch_id, courier_id ORDER BY ts DESC, message_id ASC) AS rn
          FROM d_msg m WHERE reject_reason IS NULL)
    WHERE rn = 1"""


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


#: Messages of one landed file; a folder has ``MICRO_BATCHES`` files at least twice over.
MESSAGES_PER_FILE = 100_000
MICRO_BATCHES = 4


def _message_stream(spark, sf_dir, name, copies: int = 1):
    """The message fixture landed as files (optionally delivered ``copies`` times, later
    copies with later message ids) and read back as a stream of ``MICRO_BATCHES`` micro-batches.
    Files, and so the tasks of a micro-batch, grow in number with the messages."""
    t = tables(spark, sf_dir)
    msgs = t.position_message
    n = msgs.count() * copies  # from parquet footers
    if copies > 1:
        span = msgs.agg(F.max("message_id")).first()[0] + 1
        for i in range(1, copies):
            msgs = msgs.unionByName(t.position_message.select(
                (F.col("message_id") + F.lit(span * i)).alias("message_id"), "body"))
    per_batch = max(2, -(-n // (MESSAGES_PER_FILE * MICRO_BATCHES)))
    path = _scratch(spark, name + "-in")
    write_message_files(msgs, path, num_files=per_batch * MICRO_BATCHES)
    return read_message_stream(spark, path, max_files_per_trigger=per_batch)


@register("parse_position", "F1", oracle("""
    SELECT message_id, batch_id, courier_id, ts, delivery_id, lat, lon FROM d_msg WHERE reject_reason IS NULL""",
    [MSG_PARSED]))
def q_parse_position(spark, sf_dir):
    return po.valid_positions(po.parse_messages(tables(spark, sf_dir).position_message))


@register("position_rejects", "W5", oracle("""
    SELECT message_id, batch_id, reject_reason FROM d_msg WHERE reject_reason IS NOT NULL""", [MSG_PARSED]))
def q_position_rejects(spark, sf_dir):
    return po.position_rejects(po.parse_messages(tables(spark, sf_dir).position_message))


@register("dedup_latest_in_batch", "A2", oracle("""
    SELECT batch_id, courier_id, ts, delivery_id, lat, lon, arrival_seq
    FROM (SELECT p.*, row_number() OVER (PARTITION BY batch_id, courier_id ORDER BY ts DESC, arrival_seq ASC) AS rn
          FROM d_position p)
    WHERE rn = 1"""))
def q_dedup_latest_in_batch(spark, sf_dir):
    return po.dedup_latest_in_batch(tables(spark, sf_dir).position, seq_col="arrival_seq")


@register("batch_counts", "A8", oracle("""
    SELECT batch_id, count(*) AS n_messages, count(*) FILTER (WHERE reject_reason IS NULL) AS n_valid,
           count(DISTINCT courier_id) FILTER (WHERE reject_reason IS NULL) AS n_written
    FROM d_msg GROUP BY batch_id""", [MSG_PARSED]))
def q_batch_counts(spark, sf_dir):
    return po.batch_counts(po.parse_messages(tables(spark, sf_dir).position_message))


@register("position_known_courier", "C11", oracle("""
    SELECT p.courier_id, p.ts, EXISTS (SELECT 1 FROM d_courier c WHERE c.id = p.courier_id) AS known
    FROM d_position p"""))
def q_position_known_courier(spark, sf_dir):
    t = tables(spark, sf_dir)
    pos = t.position.select("courier_id", "ts")
    acc, rej = po.known_courier_split(pos, t.courier)
    return acc.withColumn("known", F.lit(True)).unionByName(rej.withColumn("known", F.lit(False)))


@register("position_put", "S4", oracle("""
    SELECT m.courier_id, m.ts, m.delivery_id, m.lat, m.lon, c.id IS NOT NULL AS accepted,
           CASE WHEN c.id IS NULL THEN 'Courier not found.' END AS reject_reason
    FROM d_msg m LEFT JOIN d_courier c ON c.id = m.courier_id
    WHERE m.reject_reason IS NULL AND m.delivery_id IS NOT NULL""", [MSG_PARSED]))
def q_position_put(spark, sf_dir):
    """Position reports = messages in the API shape (they carry a delivery): the accepted
    ones are put into a history and read back from it, the others have a reason."""
    t = tables(spark, sf_dir)
    reports = po.valid_positions(po.parse_messages(t.position_message)) \
        .where(F.col("delivery_id").isNotNull()).select("courier_id", "ts", "delivery_id", "lat", "lon")
    checked = po.position_put(reports, t.courier)
    path = _scratch(spark, "s4-history")
    sp.write_history(checked.where("accepted").withColumn("batch_id", F.lit(0)), path, 0)
    put = sp.read_history(spark, path).select(*reports.columns, F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reject_reason"))
    return put.unionByName(checked.where("NOT accepted"))


@register("stream_positions", "S2", oracle("""
    SELECT message_id, batch_id, CASE WHEN reject_reason IS NULL THEN courier_id END AS courier_id, CASE WHEN reject_reason IS NULL THEN ts END AS ts,
           CASE WHEN reject_reason IS NULL THEN lat END AS lat, CASE WHEN reject_reason IS NULL THEN lon END AS lon, reject_reason
    FROM d_msg""", [MSG_PARSED]))
def q_stream_positions(spark, sf_dir):
    """Every message read once through the streaming file source with its body, which is read out afterwards."""
    messages = _message_stream(spark, sf_dir, "s2")
    out, ck = _scratch(spark, "s2-out"), _scratch(spark, "s2-ck")
    sp.start_append(messages, out, ck).awaitTermination()
    parsed = po.parse_messages(spark.read.parquet(out))
    fields = [F.when(F.col("reject_reason").isNull(), F.col(c)).alias(c) for c in ("courier_id", "ts", "lat", "lon")]
    return parsed.select("message_id", F.expr("message_id div 10").alias("batch_id"), *fields, "reject_reason")


@register("position_history_sink", "S3", oracle(CONDENSED_SQL, [MSG_PARSED]))
def q_position_history_sink(spark, sf_dir):
    """Batch use of the sink: condensed positions written as one epoch."""
    t = tables(spark, sf_dir)
    path = _scratch(spark, "s3-history")
    sp.write_history(po.dedup_latest_in_batch(po.valid_positions(po.parse_messages(t.position_message))), path, 0)
    return sp.read_history(spark, path).drop("date")


@register("stream_condense", "W1", oracle(CONDENSED_SQL, [MSG_PARSED]))
def q_stream_condense(spark, sf_dir):
    messages = _message_stream(spark, sf_dir, "w1")
    hist, rej, ck = _scratch(spark, "w1-history"), _scratch(spark, "w1-rejects"), _scratch(spark, "w1-ck")
    sp.start_condense(messages, hist, rej, ck).awaitTermination()
    return sp.read_history(spark, hist).drop("date")


def _condense_with_copies(spark, sf_dir, name):
    messages = _message_stream(spark, sf_dir, name)
    hist, rej, ck, counts, tracks = (_scratch(spark, f"{name}-{x}") for x in ("history", "rejects", "ck", "counts", "tracks"))
    sp.start_condense(messages, hist, rej, ck, counts_path=counts, track_path=tracks).awaitTermination()
    return counts, tracks


@register("stream_batch_counts", "A8s", oracle("""
    SELECT batch_id, CAST(count(*) AS BIGINT) AS n_messages, count(*) FILTER (WHERE reject_reason IS NULL) AS n_valid,
           count(DISTINCT courier_id) FILTER (WHERE reject_reason IS NULL) AS n_written
    FROM d_msg GROUP BY batch_id""", [MSG_PARSED]))
def q_stream_batch_counts(spark, sf_dir):
    """The counts that the condensing job writes as it runs."""
    return sp.read_counts(spark, _condense_with_copies(spark, sf_dir, "a8")[0])


@register("stream_delivery_tracks", "T4s", oracle(f"""
    SELECT delivery_id, courier_id, ts, lat, lon FROM ({CONDENSED_SQL}) WHERE delivery_id IS NOT NULL""", [MSG_PARSED]))
def q_stream_delivery_tracks(spark, sf_dir):
    """The copy by delivery that the condensing job keeps."""
    return sp.read_tracks(spark, _condense_with_copies(spark, sf_dir, "t4")[1])


@register("stream_latest_position", "W2", oracle("""
    SELECT courier_id, ts, delivery_id, lat, lon
    FROM (SELECT m.*, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, message_id DESC) AS rn
          FROM d_msg m WHERE reject_reason IS NULL)
    WHERE rn = 1""", [MSG_PARSED]))
def q_stream_latest_position(spark, sf_dir):
    messages = _message_stream(spark, sf_dir, "w2")
    log, ck = _scratch(spark, "w2-log"), _scratch(spark, "w2-ck")
    sp.start_latest_position(messages, log, ck).awaitTermination()
    return sp.read_current_positions(spark, log)


@register("stream_redelivery_dedup", "W3", oracle("""
    SELECT DISTINCT courier_id, ts, delivery_id, lat, lon FROM d_msg WHERE reject_reason IS NULL""", [MSG_PARSED]))
def q_stream_redelivery_dedup(spark, sf_dir):
    """Every message delivered twice (at-least-once worst case), fed in several
    micro-batches that span the whole month; copies are dropped by
    (courier_id, ts), late first deliveries are kept."""
    messages = _message_stream(spark, sf_dir, "w3", copies=2)
    out, ck = _scratch(spark, "w3-out"), _scratch(spark, "w3-ck")
    dedup = sp.redelivery_dedup_stream(messages) \
        .select("courier_id", "ts", "delivery_id", "lat", "lon")
    sp.start_append(dedup, out, ck).awaitTermination()
    return spark.read.parquet(out).select("courier_id", "ts", "delivery_id", "lat", "lon")
