"""GPS message source (S2): message files in, streaming DataFrame out.

In production the same DataFrame comes from Kafka (``value`` cast to string
as ``body``, partition and offset as ``message_id``); the file source stands in for it
here.  Files hold whole receive batches, so a micro-batch never splits one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow.schema import RAW_MESSAGE, RECEIVE_BATCH_SIZE


def write_message_files(messages: DataFrame, path: str, num_files: int = 8,
                        batch_size: int = RECEIVE_BATCH_SIZE) -> None:
    """Land raw messages as parquet files, each holding whole receive
    batches (range-partitioned on the batch number)."""
    b = F.expr(f"message_id div {int(batch_size)}")
    (messages.select("message_id", "body")
     .repartitionByRange(num_files, b)
     .sortWithinPartitions("message_id")
     .write.mode("overwrite").parquet(path))


def read_message_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_MESSAGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


PARTITION_BITS = 48


def read_kafka_messages(spark: SparkSession, bootstrap: str, topic: str,
                        batch_size: int = RECEIVE_BATCH_SIZE) -> DataFrame:
    """Same shape from a Kafka topic (needs the Kafka connector on the
    classpath; not used in tests)."""
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic).load())
    return kafka_rows(raw, batch_size)


def kafka_rows(raw: DataFrame, batch_size: int = RECEIVE_BATCH_SIZE) -> DataFrame:
    """(partition, offset, value) -> message_id, body.  Each partition's ids
    begin at a multiple of the batch size, so batches stay within it."""
    base = F.expr(f"((1L << {PARTITION_BITS}) div {int(batch_size)}) * {int(batch_size)}L")
    return raw.select((F.col("partition").cast("bigint") * base + F.col("offset")).alias("message_id"),
                      F.col("value").cast("string").alias("body"))
