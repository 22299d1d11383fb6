"""Report comments as rows.

The stored report row holds all of its comments as JSON text, so appending
rewrites the report and gathers its comments. Here a comment is a row of a
child table, in one folder a batch; an append writes the new rows only, and
an array is built only for the reports that a view asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fleetcast.functions.coerce import falsy_default
from fleetcast.sources.snapshots import COMMENT

#: Order of a report's comments: ``batch`` (0: stored before), then ``seq``.
SCHEMA = "report_id long, seq long, author string, message string, created_at string, batch long"
SALTS = 16                # tasks that share the comments of one report


def stored_comments(reports: DataFrame) -> DataFrame:
    """The comments inside stored reports as rows of batch 0. Null, empty or
    unreadable JSON text holds none."""
    old = F.from_json(F.nullif(F.col("comments"), F.lit("")), ArrayType(COMMENT))
    rows = reports.select(F.col("id").cast("long").alias("report_id"), F.posexplode(old).alias("seq", "c"))
    return rows.select("report_id", F.col("seq").cast("long").alias("seq"), "c.author", "c.message",
                       F.col("c.createdAt").alias("created_at"), F.lit(0).cast("long").alias("batch"))


def new_comments(reports: DataFrame, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """N2 + N3: the rows that a batch (report_id, seq, author, message,
    optional createdAt and ts) adds, and its rejects (id, seq, reason) for
    reports that don't exist or a null id.

    Author, message and time default as in ``append_comments``. A report that
    gets most of a batch is met by ``SALTS`` tasks: its id is repeated, its
    comments are not gathered. Repeated comments stay.
    """
    stamp = (F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
             if "ts" in batch.columns else F.lit(None).cast("string"))
    given = F.nullif(F.col("createdAt"), F.lit("")) if "createdAt" in batch.columns else F.lit(None).cast("string")
    rows = batch.select(F.col("report_id").cast("long").alias("report_id"), F.col("seq").cast("long").alias("seq"),
                        falsy_default("author", "Anonymous").alias("author"),
                        F.coalesce(F.col("message"), F.lit("")).alias("message"),
                        F.coalesce(given, stamp, F.lit("")).alias("created_at"), F.lit(batch_id).cast("long").alias("batch"))
    asked = rows.select(F.col("report_id").alias("_id")).distinct()                     # combined before the shuffle
    known = (reports.select(F.col("id").cast("long").alias("_id")).distinct().join(asked, "_id")
             .select("_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("seq", "message"), F.lit(SALTS)).cast("int"))
    on = (F.col("report_id") == F.col("_id")) & (salted["_salt"] == known["_salt"])
    fresh = salted.join(known, on, "left_semi").drop("_salt")
    rejects = salted.join(known, on, "left_anti").select(F.col("report_id").alias("id"), "seq", F.lit("unknown_report").alias("reason"))
    return fresh, rejects


def write_comments(rows: DataFrame, path: str) -> None:
    """Append batches to the child table. A batch that is written again
    replaces its own folder and nothing else."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def comment_totals(comments: DataFrame) -> DataFrame:
    """Per report: comments, characters, first and last author; combined
    before the shuffle, so a hot report costs one row a task."""
    at = F.struct("batch", "seq", "message", "author")      # ties by their content, whatever the partitions
    return comments.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum(F.length("message")).cast("long").alias("message_chars"),
        F.min_by("author", at).alias("first_author"), F.max_by("author", at).alias("last_author"))


def newest_comments(comments: DataFrame, n: int = 20) -> DataFrame:
    """A page: each report's ``n`` newest comments with their ``rank`` from 1.
    First per (report, salt), then among at most ``SALTS`` x n rows a report."""
    newest = [F.col("batch").desc(), F.col("seq").desc(), F.col("message").desc(), F.col("author").desc()]
    salted = comments.withColumn("_salt", F.pmod(F.xxhash64("seq", "message"), F.lit(SALTS)).cast("int"))
    few = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("report_id", "_salt").orderBy(*newest)))
           .filter(F.col("rank") <= n).drop("_salt"))
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("report_id").orderBy(*newest))).filter(F.col("rank") <= n)


def with_comments(reports: DataFrame, comments: DataFrame) -> DataFrame:
    """The reports of a view with ``comments`` as the stored JSON text. The
    answer holds a report's comments in one row: pass the reports asked for."""
    ids = reports.select(F.col("id").cast("long").alias("report_id")).distinct()
    one = F.struct("author", "message", F.col("created_at").alias("createdAt"))
    arrays = (comments.join(ids, "report_id", "left_semi").groupBy("report_id")
              .agg(F.array_sort(F.collect_list(F.struct("batch", "seq", one.alias("c")))).alias("_all")))
    j = reports.join(arrays, reports["id"] == arrays["report_id"], "left")
    text = F.coalesce(F.to_json(F.transform("_all", lambda x: x["c"])), F.lit("[]"))
    return j.select(*[text.alias(c) if c == "comments" else F.col(c) for c in reports.columns])
