"""Skew-safe per-key numbering equals row_number() over a window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from courierflow.operators.merge import assign_ids
from courierflow.operators.ranking import rank_within_key


def _check(spark, df, keys, order_cols, window_order):
    got = rank_within_key(df, keys, order_cols, out="rn")
    w = Window.partitionBy(*keys).orderBy(*window_order)
    bad = got.withColumn("ref", F.row_number().over(w)).where(F.col("rn") != F.col("ref")).count()
    assert bad == 0
    assert got.count() == df.count()


def test_hot_key_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        # one key holds 60% of the rows, the rest spread over 40 keys
        df = spark.range(0, 3000).select(
            F.when(F.col("id") % 5 < 3, F.lit(0)).otherwise(F.col("id") % 40 + 1).alias("k"),
            ((F.col("id") * 7919) % 3001).alias("v"), F.col("id"))
        _check(spark, df, ["k"], ["v", "id"], ["v", "id"])
        _check(spark, df, ["k"], [F.col("v").desc(), F.col("id").desc()], [F.col("v").desc(), F.col("id").desc()])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rank_survives_union(spark):
    df = spark.range(0, 500).select(F.lit(1).alias("k"), ((F.col("id") * 31) % 500).alias("v"))
    other = spark.range(0, 20).select(F.lit(9).alias("k"), F.lit(-1).cast("bigint").alias("v"), F.lit(0).cast("bigint").alias("rn"))
    u = other.unionByName(rank_within_key(df, ["k"], ["v"], out="rn"))
    assert u.where((F.col("k") == 1) & (F.col("rn") != F.col("v") + 1)).count() == 0


def test_assign_ids_after_max(spark):
    table = spark.createDataFrame([(5,), (9,)], "id bigint")
    batch = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "name string, seq int")
    out = {r.name: r.id for r in assign_ids(batch, ["seq"], table).collect()}
    assert out == {"a": 10, "b": 11, "c": 12}
