"""File sources and sinks.

* S1/S2: booking CSV with an explicit all-text schema (no inference pass),
  then a required-column check on the driver (column names only).
* S6: forecast CSV sink with the reference's column names; Spark writes one
  file per partition into the folder.
* S9: change payloads from JSON lines; malformed records are kept in a
  reject frame instead of being turned into empty payloads.
* S10: a one-pass column profile; S11: a one-row metrics frame as JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.operators.features import BASE_NUMERIC_COLUMNS, DATE_COLUMNS

BOOKING_CSV_COLUMNS = [*BASE_NUMERIC_COLUMNS, *DATE_COLUMNS, "Car_Cancellation"]


def read_booking_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                     required: list[str] | None = None) -> DataFrame:
    """S1 + S2: every column read as text (coercion happens in the feature
    build), header row, no schema inference (it would scan the data twice).
    Missing required columns raise with the names sorted."""
    header = spark.read.option("header", True).csv(path).columns   # reads the first line only
    missing = sorted(set(required or []).difference(header))
    if missing:
        raise ValueError("The dataset lacks required columns: " + ", ".join(missing))
    absent = sorted(set(columns or []).difference(header))
    if absent:
        raise ValueError("No such columns in the file: " + ", ".join(absent))
    # the whole header is the schema, and each file's own header is checked against it: a file whose columns
    # differ or stand in another order fails instead of being read by position
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return rows.select(*[F.col(f"`{c}`") for c in columns]) if columns else rows


def write_forecast_csv(forecast: DataFrame, path: str, holdout: bool = False) -> None:
    """S6 + P7: the forecast (or the hold-out table) in the CSV layout of
    the reference's exports. Several series go to one folder each
    (``series_id=...``)."""
    key = ["series_id"] if "series_id" in forecast.columns else []
    if holdout:
        out = forecast.select(*key, F.date_format("ds", "yyyy-MM-dd").alias("Date"),
                              F.col("y").cast("long").alias("Actual"),
                              F.col("yhat").alias("Predicted"),
                              F.col("yhat_lower").alias("Lower_Bound"),
                              F.col("yhat_upper").alias("Upper_Bound"))
    else:
        out = forecast.select(*key, F.date_format("ds", "yyyy-MM-dd").alias("Date"),
                              F.col("yhat").alias("Forecast"),
                              F.col("yhat_lower").alias("Lower_Bound"),
                              F.col("yhat_upper").alias("Upper_Bound"))
    out.write.mode("overwrite").option("header", True).partitionBy(*key).csv(path)


CHANGE_SCHEMA = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("id", T.LongType()), T.StructField("actor_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
    T.StructField("payload", T.StringType()),
    T.StructField("_corrupt_record", T.StringType())])


def read_changes_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines change rows -> (valid changes, rejects).

    A line that is not valid JSON lands in ``_corrupt_record`` (PERMISSIVE
    mode) and goes to the reject frame with its text. The lines are read as
    text and parsed here, so each frame is a lazy scan and nothing is cached.
    """
    parsed = F.from_json("value", CHANGE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    bad = df.filter(F.col("_corrupt_record").isNotNull()).select(
        F.col("_corrupt_record").alias("record"), F.lit("malformed JSON").alias("reason"))
    ok = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return ok, bad


def profile(frame: DataFrame, columns: list[str] | None = None,
            quartiles: bool = False) -> DataFrame:
    """Per numeric column count, nulls, mean, stddev, min, max (and
    approximate quartiles on request), all in one aggregation pass, returned
    one row per column."""
    num = columns or [f.name for f in frame.schema.fields
                      if isinstance(f.dataType, T.NumericType)]
    stats = ["count", "nulls", "mean", "std", "min", "max"] + (["q25", "q50", "q75"]
                                                               if quartiles else [])
    aggs = []
    for c in num:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}|count"),
                 F.sum(x.isNull().cast("long")).cast("double").alias(f"{c}|nulls"),
                 F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|std"),
                 F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
        if quartiles:
            q = F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
            aggs += [q[0].alias(f"{c}|q25"), q[1].alias(f"{c}|q50"), q[2].alias(f"{c}|q75")]
    wide = frame.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                        *[F.col(f"`{c}|{s}`").alias(s) for s in stats])
                               for c in num]))
    return wide.select(rows.alias("r")).select("r.*").select(
        "column", F.col("count").cast("long").alias("count"),
        F.col("nulls").cast("long").alias("nulls"), *stats[2:])


def schema_table(frame: DataFrame) -> DataFrame:
    """The schema as rows (column, type, nullable)."""
    spark = frame.sparkSession
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable)
                                  for f in frame.schema.fields],
                                 "column string, type string, nullable boolean")


def metrics_json(metrics: DataFrame) -> DataFrame:
    """A one-row metrics frame as one JSON text column."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("metrics"))
