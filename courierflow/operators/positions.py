"""GPS position operators: parse (F1), in-batch condensation (A2), batch
counts (A8), known-courier gate (C11 / S4), reject routing (W5).

All operators here work unchanged on a batch DataFrame and on a streaming
DataFrame inside ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.schema import MESSAGE_BODY, RECEIVE_BATCH_SIZE

REASON_UNPARSEABLE = "unparseable body"
REASON_NO_COURIER = "missing or invalid courier_id"
REASON_BAD_TIME = "missing or invalid timestamp"
REASON_NO_COORDS = "missing or invalid coordinates"
REASON_UNKNOWN_COURIER = "Courier not found."


_ZONED = r"[0-9]{1,2}:[0-9]{2}.*([Zz]|[+-][0-9]{1,2}(:?[0-9]{2})?|[A-Za-z]+/[A-Za-z_]+|UTC|GMT)\s*$"


def _parse_time(text):
    """ISO text or epoch-millis number -> timestamp_ntz (UTC wall clock).
    ``try_*`` forms: ANSI mode is on, a bad value must give null, not fail."""
    # epoch millis are UTC: add them to the naive epoch (no session time zone)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    millis = F.when(text.rlike(r"^-?[0-9]+$"),
                    F.timestamp_add("MILLISECOND", text.try_cast("bigint"), epoch))
    # a zone or offset after the clock time makes it an instant: to UTC, then naive
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(text.try_cast("timestamp")), epoch)
    zoned = F.when(text.rlike(_ZONED), instant)
    return F.coalesce(millis, zoned, F.when(~text.rlike(_ZONED), text.try_cast("timestamp_ntz")))


def parse_messages(raw: DataFrame, batch_size: int = RECEIVE_BATCH_SIZE) -> DataFrame:
    """JSON bodies -> canonical positions, both message shapes.

    Output: message_id, batch_id (receive batch = message_id div batch size),
    courier_id, ts, delivery_id, lat, lon, reject_reason (null = valid).
    """
    b = F.from_json("body", MESSAGE_BODY)
    p = raw.select("message_id", "body", b.alias("m"))
    courier = F.col("m.courier_id").try_cast("bigint")
    lat = F.coalesce(F.col("m.lat").try_cast("double"), F.col("m.lat_courier").try_cast("double"))
    lon = F.coalesce(F.col("m.lng").try_cast("double"), F.col("m.lon_courier").try_cast("double"))
    ts = _parse_time(F.col("m.timestamp"))
    parsed_ok = F.col("m").isNotNull() & F.col("body").isNotNull() & F.try_parse_json("body").isNotNull()
    reason = (F.when(~parsed_ok, F.lit(REASON_UNPARSEABLE))
              .when(courier.isNull(), F.lit(REASON_NO_COURIER))
              .when(ts.isNull(), F.lit(REASON_BAD_TIME))
              .when(lat.isNull() | lon.isNull(), F.lit(REASON_NO_COORDS)))
    return p.select(
        "message_id",
        F.expr(f"message_id div {int(batch_size)}").alias("batch_id"),
        courier.alias("courier_id"), ts.alias("ts"), F.col("m.delivery_id").alias("delivery_id"),
        lat.alias("lat"), lon.alias("lon"), reason.alias("reject_reason"),
    )


def valid_positions(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def position_rejects(parsed: DataFrame) -> DataFrame:
    """Messages that cannot become positions, with the reason.  One bad
    body no longer blocks its batch: it is routed aside."""
    return parsed.where(F.col("reject_reason").isNotNull()).select("message_id", "batch_id", "reject_reason")


def dedup_latest_in_batch(pos: DataFrame, batch_col: str = "batch_id", seq_col: str = "message_id") -> DataFrame:
    """A2: newest message per (receive batch, courier); on equal timestamps
    the first received wins (order key (ts, -seq)).  Partial aggregation."""
    best = F.max_by(F.struct("ts", "delivery_id", "lat", "lon", seq_col),
                    F.struct(F.col("ts"), (-F.col(seq_col)).alias("neg_seq")))
    return pos.groupBy(batch_col, "courier_id").agg(best.alias("b")).select(
        batch_col, "courier_id", F.col("b.ts").alias("ts"), F.col("b.delivery_id").alias("delivery_id"),
        F.col("b.lat").alias("lat"), F.col("b.lon").alias("lon"), F.col(f"b.{seq_col}").alias(seq_col))


def batch_counts(parsed: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per receive batch, messages in, valid messages, rows written
    (distinct couriers among valid messages)."""
    valid = F.col("reject_reason").isNull()
    return parsed.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count(F.when(valid, 1)).alias("n_valid"),
        F.count_distinct(F.when(valid, F.col("courier_id"))).alias("n_written"),
    )


def known_courier_split(pos: DataFrame, courier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C11: positions of existing couriers (accepted, semi-join) and of
    unknown couriers (rejected, anti-join)."""
    c = courier.select(F.col("id").alias("courier_id"))
    return pos.join(c, "courier_id", "left_semi"), pos.join(c, "courier_id", "left_anti")


def position_put(reports: DataFrame, courier: DataFrame) -> DataFrame:
    """Position reports with the courier existence check, as one
    DataFrame with ``accepted`` and ``reject_reason``.  The report carries its
    own time; a live job stamps ``current_timestamp()`` before this."""
    c = courier.select(F.col("id").alias("courier_id"), F.lit(True).alias("_known"))
    out = reports.join(c, "courier_id", "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    return out.select(*[x for x in reports.columns], known.alias("accepted"),
                      F.when(~known, F.lit(REASON_UNKNOWN_COURIER)).alias("reject_reason"))


def stamp_server_time(reports: DataFrame, col: str = "ts") -> DataFrame:
    """S4 live form: the server's receive time as naive UTC (epoch micros of
    ``current_timestamp()`` added to the naive epoch, so the session time
    zone plays no part).  Never used in checked queries (not repeatable)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return reports.withColumn(col, F.timestamp_add("MICROSECOND", F.unix_micros(F.current_timestamp()), epoch))
