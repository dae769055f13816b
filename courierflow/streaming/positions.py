"""Streaming position jobs (W1 condense, S3 history sink, W2 current
position, W3 redelivery dedup, W5 rejects).

Delivery guarantees: the source offsets and the sink writes are tied by the
checkpoint.  Each ``foreachBatch`` write replaces exactly the partitions of
its own job and epoch (dynamic partition overwrite), so a micro-batch that is
re-run after a failure rewrites the same rows instead of adding copies.  The
original "retry after 2 s" loop becomes the query restart policy.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from courierflow.operators.positions import (batch_counts, dedup_latest_in_batch, parse_messages, position_rejects,
                                             valid_positions)
from courierflow.schema import QUEUE_RETENTION_SECONDS


def _job_id(df: DataFrame) -> str:
    """Identity of the running streaming query, kept in its checkpoint; a job
    with a new or lost checkpoint is another job and replaces nothing.
    Outside a stream (batch use) every write is a job of its own."""
    running = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return running or f"batch-{uuid.uuid4().hex}"


def _write_epoch(df: DataFrame, path: str, epoch_id: int, cluster_by: list[str] | None = None,
                 by_date: str | None = None) -> None:
    out = df.withColumn("job", F.lit(_job_id(df))).withColumn("epoch", F.lit(int(epoch_id)))
    parts = ["job", "epoch"]
    if by_date:
        out = out.withColumn("date", F.to_date(by_date))
        parts = ["date", *parts]
    if cluster_by:
        # rows of one key sit together in each file: parquet row-group
        # min/max statistics then skip most of a file for a per-key lookup
        out = out.sortWithinPartitions(*(["date"] if by_date else []), *cluster_by)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(path))


def write_history(condensed: DataFrame, path: str, epoch_id: int) -> None:
    """S3: keyed put of condensed positions for one epoch (replay-safe), by
    date, clustered by the store's key (courier_id, ts).  ``put_at`` (clock
    micros of the write) orders puts of different jobs under one key."""
    put = condensed.select("batch_id", "courier_id", "ts", "delivery_id", "lat", "lon", F.lit(time.time_ns() // 1000).alias("put_at"))
    _write_epoch(put, path, epoch_id, cluster_by=["courier_id", "ts"], by_date="ts")


_PUT_ORDER = ["put_at", "batch_id"]


def _latest_puts(h: DataFrame) -> DataFrame:
    """One row per (courier_id, ts): a later put under the same key wins."""
    last = F.max_by(F.struct("delivery_id", "lat", "lon", *_PUT_ORDER), F.struct(*_PUT_ORDER))
    return h.groupBy("date", "courier_id", "ts").agg(last.alias("r")).select("courier_id", "ts", "r.*", "date")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Position history as the key-value store would hold it: one row per
    (courier_id, ts).  A filter on ``date`` reads only its folders."""
    return _latest_puts(spark.read.parquet(path)).select("courier_id", "ts", "delivery_id", "lat", "lon", "date")


def compact_history(spark: SparkSession, path: str, into: str) -> None:
    """Rewrite the history with one sorted set of files per date into a new
    folder (readers switch to it; later epochs may be appended to it)."""
    rows = _latest_puts(spark.read.parquet(path)).withColumn("job", F.lit("compacted")).withColumn("epoch", F.lit(-1))
    (rows.repartitionByRange("date", "courier_id", "ts").sortWithinPartitions("date", "courier_id", "ts")
     .write.partitionBy("date", "job", "epoch").parquet(into))


def write_tracks(condensed: DataFrame, path: str, epoch_id: int) -> None:
    """T4's access path: a second copy of an epoch's positions by delivery.  It is
    range-partitioned and sorted on (delivery_id, ts), so a delivery's rows lie in
    one or two files of an epoch and row-group statistics skip the rest."""
    put = condensed.where(F.col("delivery_id").isNotNull()).select(
        "batch_id", "courier_id", "ts", "delivery_id", "lat", "lon", F.lit(time.time_ns() // 1000).alias("put_at"))
    _write_epoch(put.repartitionByRange("delivery_id", "ts"), path, epoch_id, cluster_by=["delivery_id", "ts"])


def read_tracks(spark: SparkSession, path: str, deliveries: list[str] | None = None) -> DataFrame:
    """Positions by delivery, one row per (delivery_id, courier_id, ts); the filter on
    ``deliveries`` reaches the scan.  A put that moves a (courier_id, ts) to another
    delivery leaves its earlier row in the earlier track until ``compact_tracks``."""
    rows = spark.read.parquet(path)
    if deliveries is not None:
        rows = rows.where(F.col("delivery_id").isin(*deliveries)) if deliveries else rows.where("1 = 0")
    last = F.max_by(F.struct("lat", "lon"), F.struct(*_PUT_ORDER))
    return rows.groupBy("delivery_id", "courier_id", "ts").agg(last.alias("r")).select("delivery_id", "courier_id", "ts", "r.*")


def compact_tracks(spark: SparkSession, path: str, into: str) -> None:
    """Rewrite the copy by delivery as one sorted set of files, last put per (courier_id, ts)."""
    last = F.max_by(F.struct("delivery_id", "lat", "lon", *_PUT_ORDER), F.struct(*_PUT_ORDER))
    rows = spark.read.parquet(path).groupBy("courier_id", "ts").agg(last.alias("r")).select("courier_id", "ts", "r.*")
    rows = rows.withColumn("job", F.lit("compacted")).withColumn("epoch", F.lit(-1))
    (rows.repartitionByRange("delivery_id", "ts").sortWithinPartitions("delivery_id", "ts")
     .write.partitionBy("job", "epoch").parquet(into))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A8 as the running job wrote it, per receive batch (summed where a source split one)."""
    return spark.read.parquet(path).groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in ("n_messages", "n_valid", "n_written")])


def condense_batch(history_path: str, reject_path: str, counts_path: str | None = None, track_path: str | None = None):
    """foreachBatch body of W1: parse, route rejects, keep the newest message
    per (receive batch, courier), write the outputs for this epoch; where a path
    is given also the batch counts (A8) and the copy by delivery (T4)."""
    def fn(batch: DataFrame, epoch_id: int) -> None:
        parsed = parse_messages(batch).persist()
        try:
            condensed = dedup_latest_in_batch(valid_positions(parsed))
            write_history(condensed, history_path, epoch_id)
            _write_epoch(position_rejects(parsed), reject_path, epoch_id)
            if counts_path:
                _write_epoch(batch_counts(parsed), counts_path, epoch_id)
            if track_path:
                write_tracks(condensed, track_path, epoch_id)
        finally:
            parsed.unpersist()
    return fn


def start_condense(stream: DataFrame, history_path: str, reject_path: str, checkpoint_path: str,
                   available_now: bool = True, processing_time: str | None = None,
                   counts_path: str | None = None, track_path: str | None = None) -> StreamingQuery:
    """Receive -> dedup -> put -> acknowledge (= offset commit)."""
    w = stream.writeStream.foreachBatch(condense_batch(history_path, reject_path, counts_path, track_path)) \
        .option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "5 seconds")
    return w.start()


def latest_position_stream(stream: DataFrame) -> DataFrame:
    """Newest position per courier regardless of arrival order.  A
    streaming ``max_by`` keeps one state row per courier; a late, older
    message cannot replace a newer one."""
    pos = valid_positions(parse_messages(stream))
    newest = F.max_by(F.struct("ts", "delivery_id", "lat", "lon", "message_id"), F.struct("ts", "message_id"))
    return pos.groupBy("courier_id").agg(newest.alias("p")).select(
        "courier_id", F.col("p.ts").alias("ts"), F.col("p.delivery_id").alias("delivery_id"),
        F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.col("p.message_id").alias("message_id"))


def start_latest_position(stream: DataFrame, log_path: str, checkpoint_path: str,
                          available_now: bool = True) -> StreamingQuery:
    """Update-mode output: each epoch writes the couriers whose newest
    position changed; :func:`read_current_positions` reduces the log and
    :func:`compact_current_positions` bounds it to a row per courier."""
    w = (latest_position_stream(stream).writeStream.outputMode("update")
         .foreachBatch(lambda df, epoch: _write_epoch(df, log_path, epoch))
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def compact_current_positions(spark: SparkSession, log_path: str, into: str) -> None:
    """A new log folder with one row per courier; later epochs append to it."""
    newest = F.max_by(F.struct("ts", "delivery_id", "lat", "lon", "message_id"), F.struct("ts", "message_id"))
    rows = spark.read.parquet(log_path).groupBy("courier_id").agg(newest.alias("p")).select("courier_id", "p.*")
    (rows.withColumn("job", F.lit("compacted")).withColumn("epoch", F.lit(-1))
     .write.partitionBy("job", "epoch").parquet(into))


def read_current_positions(spark: SparkSession, log_path: str) -> DataFrame:
    log = spark.read.parquet(log_path)
    cur = F.max_by(F.struct("ts", "delivery_id", "lat", "lon"), F.struct("ts", "message_id"))
    return log.groupBy("courier_id").agg(cur.alias("p")).select(
        "courier_id", F.col("p.ts").alias("ts"), F.col("p.delivery_id").alias("delivery_id"),
        F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def redelivery_dedup_stream(stream: DataFrame, delay_seconds: int = QUEUE_RETENTION_SECONDS) -> DataFrame:
    """Drop redelivered copies (same courier and timestamp).  A copy
    arrives at most the queue retention after the first delivery, so the
    state expires by arrival time; the message's own time never drops a row,
    however late a first delivery is."""
    pos = valid_positions(parse_messages(stream)).withColumn("arrived_at", F.current_timestamp())
    return (pos.withWatermark("arrived_at", f"{int(delay_seconds)} seconds")
            .dropDuplicatesWithinWatermark(["courier_id", "ts"]).drop("arrived_at"))


def start_append(df: DataFrame, path: str, checkpoint_path: str, available_now: bool = True) -> StreamingQuery:
    w = (df.writeStream.foreachBatch(lambda b, epoch: _write_epoch(b, path, epoch))
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
