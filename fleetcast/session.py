"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package relies on. Runtime settings are applied
# only when the site (spark-defaults, spark-submit --conf) has not set them, so
# a cluster configuration always wins. The session time zone is the exception:
# date and timestamp semantics here are UTC wall-clock, so it is always UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Launch-time settings (take effect only when this call starts the JVM).
LAUNCH_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fleetcast", driver_memory: str | None = None) -> SparkSession:
    """Session with the package defaults. ``driver_memory`` matters in local
    mode only (the driver JVM is the executor); it must be set before the
    JVM starts, i.e. on the first session of the process."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in LAUNCH_CONF.items():
        builder = builder.config(key, value)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    site = spark.sparkContext.getConf()
    for key, value in DEFAULT_CONF.items():
        if not site.contains(key):
            spark.conf.set(key, value)
    if shuffle_partitions and not site.contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the site
    (a folder every executor can reach). Only when it is unset, as in local
    tests, a fresh scratch folder is created and registered.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fleetcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), name)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of a query that ends inside go with it, for one whose
    result is written: else they stay until the driver happens to collect garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


_open_blocks: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession):
    """What ``materialize`` writes inside is deleted at the end: no frame that
    reads it may leave the block."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            forget(spark, path)


def materialize(df, name: str):
    """Compute ``df`` once and read it back from a written table.

    Used for small intermediates that several later steps (scalar
    subqueries, joins, windows) read: without it each reader would re-run
    the whole lineage back to the fact tables. The table lives in the shared
    checkpoint folder, so it survives the loss of an executor and cuts the
    lineage. Each call writes a fresh folder; the folder being read is never
    overwritten.
    """
    return written(df, name)[0]


def written(df, name: str, **options):
    """``materialize`` with options of the writer: the table and its folder."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    with shuffles_dropped(spark):
        df.write.mode("overwrite").options(**options).parquet(path)
    forget_at_exit(spark, path)
    if _open_blocks:
        _open_blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that is read no more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
