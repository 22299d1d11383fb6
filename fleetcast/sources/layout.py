"""Snapshots laid out by id: one folder for each range of
``span`` ids, so that a lookup or a patch reads, and a patch writes, only the
folders that its ids are in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from fleetcast.operators.tables import apply_patches, lookup
from fleetcast.session import materialize

SPAN = 1_000_000          # ids a folder, and so rows a writing task
MOST_PARTS = 10_000       # folders named in a plan; requests in more of them read the whole table


def _part(key: str, span: int):
    return F.floor(F.col(key) / F.lit(span)).cast("long")


def write_by_id(frame: DataFrame, path: str, key: str = "id", span: int = SPAN) -> None:
    """Write ``frame`` (distinct ids) by ranges of ``key``, sorted in each, so
    that row groups can be skipped as well. Folders that ``frame`` has no row
    of are left as they are. Rows with a null key have a folder of their own."""
    (frame.withColumn("part", _part(key, span)).repartition("part").sortWithinPartitions("part", key)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path))


def read_by_id(spark: SparkSession, path: str, schema: StructType, ids: DataFrame | None = None, key: str = "id",
               span: int = SPAN) -> DataFrame:
    """The table, or only the folders that hold the ranges of ``ids``. The
    folder numbers (at most MOST_PARTS) are the only thing that is collected."""
    table = spark.read.schema(StructType([*schema.fields]).add("part", LongType())).parquet(path)
    if ids is not None:
        parts = [r.part for r in ids.select(_part(key, span).alias("part")).filter("part is not null").distinct()
                 .limit(MOST_PARTS + 1).collect()]
        if len(parts) <= MOST_PARTS:
            table = table.filter(F.col("part").isin(parts) if parts else F.lit(False))
    return table.drop("part")


def lookup_by_id(spark: SparkSession, path: str, schema: StructType, ids: DataFrame, key: str = "id", span: int = SPAN) -> DataFrame:
    """F5 on a table laid out by id: its rows with one of ``ids``, once each.
    Null and unknown ids find nothing."""
    return lookup(read_by_id(spark, path, schema, ids, key, span), ids, key)


def patch_by_id(spark: SparkSession, path: str, schema: StructType, patches: DataFrame, fields: dict[str, tuple[str, ...]],
                key: str = "id", span: int = SPAN) -> DataFrame:
    """M3 on a table laid out by id: ``apply_patches`` on the folders that the
    patches are in, which are written again; returns the rejects. The new rows
    are complete in a scratch table before a folder is replaced, and the same
    patches may be applied again after a failure."""
    touched = read_by_id(spark, path, schema, patches, key, span)
    out, rejects = apply_patches(touched, patches, key, fields)
    rejects = materialize(rejects, "patch-rejects")
    write_by_id(materialize(out, "patched-parts"), path, key, span)
    return rejects
