"""Streaming jobs: replay safety, order independence, stream = batch."""

import datetime as dt
import glob
import json
import os
import tempfile

import pytest

from courierflow.operators import status_machine as sm
from courierflow.schema import EVENT, RAW_MESSAGE
from courierflow.sources.messages import read_message_stream
from courierflow.streaming import positions as sp
from courierflow.streaming.status import fold_requests, ordered_status_stream, start_on_rocksdb, status_transition_stream


def _msg(mid, courier, ms, lat):
    return (mid, json.dumps({"courier_id": courier, "lat": lat, "lng": -46.6, "timestamp": ms}))


def _land(spark, folder, name, rows):
    spark.createDataFrame(rows, RAW_MESSAGE).coalesce(1).write.parquet(os.path.join(folder, name))


def test_condense_replay_and_late_message(spark):
    root = tempfile.mkdtemp(prefix="cf-stream-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    t = 1704110400000
    _land(spark, src, "a", [_msg(0, 7, t + 5000, 1.0), _msg(1, 7, t + 5000, 2.0), _msg(2, 8, t, 3.0)])
    hist, rej, ck = (os.path.join(root, x) for x in ("hist", "rej", "ck"))
    sp.start_condense(read_message_stream(spark, src + "/*"), hist, rej, ck).awaitTermination()
    # a late, older message for courier 7 arrives in a later batch
    _land(spark, src, "b", [_msg(10, 7, t + 1000, 9.0), (11, "garbage")])
    sp.start_condense(read_message_stream(spark, src + "/*"), hist, rej, ck).awaitTermination()
    # restart with nothing new: replay from the checkpoint changes nothing
    sp.start_condense(read_message_stream(spark, src + "/*"), hist, rej, ck).awaitTermination()
    h = sorted((r.courier_id, r.lat) for r in sp.read_history(spark, hist).collect())
    assert h == [(7, 1.0), (7, 9.0), (8, 3.0)]  # first received wins the tie; history keeps both
    assert spark.read.parquet(rej).count() == 1

    log, ck2 = os.path.join(root, "cur"), os.path.join(root, "ck2")
    sp.start_latest_position(read_message_stream(spark, src + "/*", max_files_per_trigger=1), log, ck2).awaitTermination()
    cur = {r.courier_id: r.lat for r in sp.read_current_positions(spark, log).collect()}
    assert cur[7] in (1.0, 2.0) and cur[8] == 3.0  # the late older message cannot displace the newer


def test_redelivery_dropped(spark):
    root = tempfile.mkdtemp(prefix="cf-dedup-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    t = 1704110400000
    _land(spark, src, "a", [_msg(0, 7, t, 1.0), _msg(1, 7, t, 1.0), _msg(2, 7, t + 1, 2.0)])
    out, ck = os.path.join(root, "out"), os.path.join(root, "ck")
    sp.start_append(sp.redelivery_dedup_stream(read_message_stream(spark, src + "/*")),
                    out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_status_stream_across_batches_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="cf-w4-")
    src = os.path.join(root, "in")
    t0 = dt.datetime(2024, 1, 1)
    seq = ["CONFIRMED", "READY_FOR_PICKUP", "PREPARING", "PREPARING", "READY_FOR_PICKUP", "PICKED_UP",
           "IN_TRANSIT", "DELIVERED", "CONFIRMED"]
    rows = [(i + 1, s, t0 + dt.timedelta(minutes=i), d) for d in (1, 2) for i, s in enumerate(seq)]
    rows = [(r[0] + 100 * r[3], r[1], r[2], r[3]) for r in rows]
    # three files written in time order, consumed one per micro-batch
    for k in range(3):
        part = [r for r in rows if k * 3 <= (r[0] % 100) - 1 < (k + 1) * 3]
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(os.path.join(src, f"p{k}"))
        os.utime(os.path.join(src, f"p{k}"), None)
    out, ck = os.path.join(root, "out"), os.path.join(root, "ck")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    sp.start_append(status_transition_stream(stream), out, ck).awaitTermination()
    got = {r.id: (r.accepted, r.reject_reason) for r in spark.read.parquet(out).collect()}
    batch = {r.id: (r.accepted, r.reject_reason) for r in
             sm.status_transitions(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == batch
    assert fold_requests(-1, seq)[0] == 5


def test_counts_and_tracks_of_the_running_job(spark):
    root = tempfile.mkdtemp(prefix="cf-tracks-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    t = 1704110400000

    def report(mid, courier, delivery, ms):
        return (mid, json.dumps({"courier_id": courier, "delivery_id": delivery, "lat": 1.0, "lng": 2.0, "timestamp": ms}))

    _land(spark, src, "a", [report(0, 7, "d1", t), report(1, 7, "d1", t + 1), (2, "garbage"), report(3, 8, None, t), report(10, 9, "d2", t)])
    hist, rej, ck, counts, tracks = (os.path.join(root, x) for x in ("hist", "rej", "ck", "counts", "tracks"))
    for extra in ([], [report(20, 9, "d3", t)]):  # the second message moves a stored key to another delivery
        if extra:
            _land(spark, src, "b", extra)
        sp.start_condense(read_message_stream(spark, src + "/*"), hist, rej, ck, counts_path=counts, track_path=tracks).awaitTermination()
    assert {tuple(r) for r in sp.read_counts(spark, counts).collect()} == {(0, 4, 3, 2), (1, 1, 1, 1), (2, 1, 1, 1)}
    assert {(r.delivery_id, r.courier_id) for r in sp.read_tracks(spark, tracks).collect()} == {("d1", 7), ("d2", 9), ("d3", 9)}
    assert sp.read_tracks(spark, tracks, []).count() == 0
    compact = os.path.join(root, "compact")
    sp.compact_tracks(spark, tracks, compact)
    assert {(r.delivery_id, r.courier_id) for r in sp.read_tracks(spark, compact).collect()} == {("d1", 7), ("d3", 9)}


def test_a_delivery_lies_in_few_row_groups(spark):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    path = os.path.join(tempfile.mkdtemp(prefix="cf-tracks-"), "tracks")
    rows = spark.range(40000).select(F.lit(0).alias("batch_id"), (F.col("id") % 97).alias("courier_id"),
                                     F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
                                     F.lpad((F.col("id") * 7919 % 1000).cast("string"), 4, "0").alias("delivery_id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    # partitions stay apart, as those of a large epoch do
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sp.write_tracks(rows, path, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = []
    for f in glob.glob(path + "/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("delivery_id")
        groups += [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    assert len(groups) > 1 and sum(g.min <= "0500" <= g.max for g in groups) <= 2
    got = sp.read_tracks(spark, path, ["0500"])
    assert "In(delivery_id" in got._jdf.queryExecution().toString() or "EqualTo(delivery_id" in got._jdf.queryExecution().toString()
    assert got.count() == 40


def test_ordered_stream_of_shuffled_requests_equals_batch(spark):
    """Requests dealt over micro-batches in any order, ties in time, an early READY, repeats, a null status."""
    import random

    from courierflow.streaming.status import PROVIDER

    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT)
    before = spark.conf.get(PROVIDER, None)
    rnd = random.Random(8)
    root = tempfile.mkdtemp(prefix="cf-ordered-")
    t0 = dt.datetime(2024, 1, 1)
    names = ["CONFIRMED", "PREPARING", "READY_FOR_PICKUP", "PICKED_UP", "IN_TRANSIT", "DELIVERED"]
    rows = []
    for d in range(6):
        for i, s in enumerate(names + ["CONFIRMED", None] + rnd.sample(names, 3)):
            rows.append((len(rows) + 1, s, t0 + dt.timedelta(microseconds=rnd.randrange(4_000_000) if d else i * 500), d))
    rnd.shuffle(rows)
    late = (None, None, t0 + dt.timedelta(hours=2), None)
    for k, part in enumerate([rows[:35], rows[35:], [late]]):
        spark.createDataFrame(part, loose).coalesce(1).write.parquet(os.path.join(root, f"in/p{k}"))
        stream = spark.readStream.schema(loose).parquet(root + "/in/*")
        start_on_rocksdb(spark, lambda: sp.start_append(ordered_status_stream(stream, "1 hour"), root + "/out", root + "/ck")).awaitTermination()  # noqa: B023
        if k < 2:  # nothing is decided before the watermark passes
            assert not os.path.exists(root + "/out") or spark.read.schema("id bigint").parquet(root + "/out").count() == 0
    label = lambda r: (r.id, r.delivery_id, r.updated_at, r.status, r.accepted, r.state_before, r.reject_reason)
    got = sorted(map(label, spark.read.parquet(root + "/out").collect()), key=str)
    assert len(got) == len(rows) and spark.conf.get(PROVIDER, None) == before
    assert got == sorted(map(label, sm.status_transitions(spark.createDataFrame(rows, loose)).collect()), key=str)


@pytest.mark.parametrize("ordered", [False, True])
def test_groups_of_deliveries_share_a_call_and_keep_large_and_null_ids(spark, ordered):
    """900 deliveries in 4 groups: a call and a state row per group; ids beyond 2^53 beside null ones."""
    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT)
    root = tempfile.mkdtemp(prefix="cf-groups-")
    t0, big = dt.datetime(2024, 1, 1), (1 << 60) + 1
    names = ["CONFIRMED", "READY_FOR_PICKUP", "PREPARING"]
    rows = [(big + 3 * d + i, s, t0 + dt.timedelta(seconds=d + i), None if d == 0 else big + d) for d in range(900) for i, s in enumerate(names)]
    late = [(None, None, t0 + dt.timedelta(hours=9), None)] if ordered else []
    for k, part in enumerate([rows[:1500], rows[1500:], late]):
        if not part:
            continue
        spark.createDataFrame(part, loose).coalesce(1).write.parquet(os.path.join(root, f"in/p{k}"))
        stream = spark.readStream.schema(loose).parquet(root + "/in/*")
        labelled = ordered_status_stream(stream, "1 hour", buckets=4) if ordered else status_transition_stream(stream, buckets=4)
        query = start_on_rocksdb(spark, lambda: sp.start_append(labelled, root + "/out", root + "/ck"))  # noqa: B023
        query.awaitTermination()
        assert query.lastProgress.stateOperators[0].numRowsTotal <= 4
    got = spark.read.parquet(root + "/out")
    assert got.where("accepted").groupBy("delivery_id").count().where("count = 2").count() == 900
    assert {(r.id, r.delivery_id) for r in got.collect()} == {(r[0], r[3]) for r in rows}


def test_micro_batches_get_more_files_as_messages_grow(spark, monkeypatch):
    """1,000 messages, 50 a file: four micro-batches of five files each, every message once."""
    from courierflow.plans import position_views as pv
    from courierflow.session import checkpoint_dir

    root = tempfile.mkdtemp(prefix="cf-files-")
    spark.range(1000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 3}' AS props") \
        .write.parquet(root + "/events.parquet")
    monkeypatch.setattr(pv, "MESSAGES_PER_FILE", 50)
    name = os.path.basename(root)
    query = sp.start_append(pv._message_stream(spark, root, name), root + "/out", root + "/ck")
    query.awaitTermination()
    assert [p.numInputRows > 0 for p in query.recentProgress] == [True] * 4
    landed = checkpoint_dir(spark).removeprefix("file:") + f"/{name}-in-*/*.parquet"
    assert len(glob.glob(landed)) == 20
    got = spark.read.parquet(root + "/out").select("message_id")
    assert got.count() == 1000 == got.distinct().count()
