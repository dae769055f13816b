"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "courierflow") -> SparkSession:
    """Session with the settings every courierflow job assumes.

    * session time zone UTC (timestamps compare equal to the SQL oracle)
    * AQE on: coalesces small shuffle partitions, splits skewed join
      partitions, and turns sort-merge joins into broadcast joins only
      when the *measured* side is below the broadcast threshold
    * UI off (no HTTP server)
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master and master.startswith("local") and not os.environ.get("SPARK_DRIVER_MEMORY"):
        # local mode runs everything in the driver JVM: give it the heap
        builder = builder.config("spark.driver.memory", os.environ.get("COURIERFLOW_DRIVER_MEMORY", "16g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(master: str) -> bool:
    """One JVM on this machine (``local``, ``local[n]``); ``local-cluster`` is not."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster.

    Reads ``spark.checkpoint.dir`` from the session.  Only when it is unset
    and the master is local (tests), a fresh scratch folder is created and
    registered; on any other master every executor would write its own disk,
    so an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not _is_local(sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {sc.master}")
        configured = tempfile.mkdtemp(prefix="courierflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for tables that several branches of a plan use."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go when it ends and not when the driver's garbage collector finds them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)
