"""Structured Streaming operators.

* T1 ``apply_change_stream``: change rows arrive as a stream, in any order, and
  are merged into a state that doesn't depend on it. Per id that is, for each
  field, the latest value with its seq, the seq of the last delete, and the
  seqs of the creates. Fields of a row count from its birth on: the first
  create after the last delete. A micro-batch only appends what it adds;
  ``mergelog`` keeps the number of folders small.
* T2: a change takes effect if it is a create, or if the last create or delete
  of its id before it is a create. Those that do become event envelopes (N6),
  the others rejects, by what has arrived up to their batch. A create or a
  delete that arrives late can alter the verdict on changes after it:
  ``outcomes`` has the verdicts by all that has arrived, ``corrections`` those
  that differ from what was written.
* T3 ``run_daily_demand``: each micro-batch appends its own counts per day and
  segment; the result sums them. There is no watermark, so nothing is late.
* T4 ``score_stream``: stateless feature build and scoring of arriving rows.

Stream state and checkpoints live under ``spark.checkpoint.dir`` (a shared
folder on a cluster), so a restarted driver resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.operators.asof import asof_join
from fleetcast.operators.tables import UNKNOWN_ID, payload_map
from fleetcast.session import forget, forget_at_exit, scratch_path, shuffles_dropped
from fleetcast.sources.tables import SEGMENT_COLUMNS, read_table
from fleetcast.streaming.mergelog import EVERY, MergeLog

STATE_FIELDS = ["k", "value", "last_event"]


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a file stream (the folder is watched for new files
    named like the table)."""
    schema = read_table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(sf_dir)


def change_rows(events: DataFrame) -> DataFrame:
    """Change rows from event rows (same mapping as the batch change log)."""
    action = (F.when(F.col("event_type") == "signup", "create")
              .when(F.col("event_type") == "error", "delete").otherwise("update"))
    payload = F.to_json(F.struct(
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
        F.col("event_type").alias("last_event")))
    return events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"),
                         action.alias("action"), payload.alias("payload"),
                         F.col("ts").cast("timestamp").alias("ts"))


_VALUE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("v", T.StringType())])
REGISTERS = T.StructType([T.StructField("id", T.LongType()), T.StructField("last_seq", T.LongType()), T.StructField("deleted", T.LongType()),
                          *[T.StructField(f, _VALUE) for f in STATE_FIELDS]])
TURNS = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("turn", T.StringType())])


def registers(spark: SparkSession, base: str, every: int = EVERY) -> MergeLog:
    """Per id: the last seq, the last delete, and each field's latest value."""
    return MergeLog(spark, f"{base}/registers", REGISTERS, lambda parts: parts.groupBy("id").agg(
        *[F.max(c).alias(c) for c in ("last_seq", "deleted", *STATE_FIELDS)]), every)


def turns(spark: SparkSession, base: str, every: int = EVERY) -> MergeLog:
    """The creates and deletes of each id."""
    return MergeLog(spark, f"{base}/turns", TURNS, lambda parts: parts.distinct(), every)


def _registers_of(changes: DataFrame) -> DataFrame:
    rows = changes.withColumn("m", payload_map("payload"))
    lives = F.col("action") != "delete"
    return rows.groupBy("id").agg(
        F.max("seq").alias("last_seq"), F.max(F.when(~lives, F.col("seq"))).alias("deleted"),
        *[F.max(F.when(lives & F.col("m")[f].isNotNull(), F.struct("seq", F.col("m")[f].alias("v")))).alias(f) for f in STATE_FIELDS])


def _judged(changes: DataFrame, turns_: DataFrame) -> DataFrame:
    """``changes`` with ``reason``: null for those that take effect."""
    known = asof_join(changes, turns_, "id", "seq", ["turn"])
    alive = (F.col("action") == "create") | F.col("turn").eqNullSafe(F.lit("create"))
    return known.select(*changes.columns, F.when(~alive, UNKNOWN_ID).alias("reason"))


def apply_change_stream(spark: SparkSession, changes: DataFrame, base: str, checkpoint: str, every: int = EVERY) -> list[int]:
    """T1 + T2: run the change stream (id, seq, action, payload) to the end of
    the available input (``availableNow``); returns the batches that ran. A
    change that arrives twice counts once. ``every``: folders that are merged
    into one."""
    done: list[int] = []

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        session, tag = batch.sparkSession, f"batch={batch_id:012d}"
        # the batch is read several times: once from the source, then from the shared folder
        batch.select("id", "seq", "action", "payload").write.mode("overwrite").parquet(f"{base}/arrived/{tag}")
        arrived = session.read.parquet(f"{base}/arrived/{tag}").dropDuplicates(["id", "seq"])
        registers(session, base, every).append(_registers_of(arrived), batch_id)
        log = turns(session, base, every)
        new = arrived.filter("action <> 'update'").select("id", "seq", F.col("action").alias("turn"))
        log.append(new.distinct(), batch_id)
        known = log.read().join(arrived.select("id").distinct(), "id", "left_semi")
        _judged(arrived, known).write.mode("overwrite").parquet(f"{base}/judged/{tag}")
        judged = session.read.parquet(f"{base}/judged/{tag}")
        judged.filter("reason is not null").select("id", "seq", "action", "reason").write.mode("overwrite").parquet(f"{base}/rejects/{tag}")
        (judged.filter("reason is null")
         .select(F.lit("profile").alias("type"), F.concat(F.col("action"), F.lit("d")).alias("action"), "id", "payload", "seq")
         .write.mode("overwrite").json(f"{base}/events/{tag}"))
        done.append(batch_id)

    q = (changes.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return done


def latest_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The rows that exist now (by the manifests: also right after a restart
    that found no new input): id, the fields, last_seq."""
    state = registers(spark, base).read()
    births = turns(spark, base).read().filter("turn = 'create'").select("id", F.col("seq").alias("at"))
    born = (births.join(state.select("id", "deleted"), "id").filter(F.col("deleted").isNull() | (F.col("at") > F.col("deleted")))
            .groupBy("id").agg(F.min("at").alias("born")))
    return state.join(born, "id").select("id", *[F.when(F.col(f"{f}.seq") >= F.col("born"), F.col(f"{f}.v")).alias(f) for f in STATE_FIELDS], "last_seq")


def _arrived(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/judged").select("id", "seq", "action", "reason")


def outcomes(spark: SparkSession, base: str) -> DataFrame:
    """id, seq, action, reason of every change, by all that has arrived."""
    rows = _arrived(spark, base).dropDuplicates(["id", "seq"]).drop("reason")
    return _judged(rows, turns(spark, base).read())


def corrections(spark: SparkSession, base: str) -> DataFrame:
    """The changes whose envelope or reject was written before a create or a
    delete arrived that comes earlier: id, seq, action, the verdict that was
    ``written`` and the ``reason`` that holds (null: it took effect)."""
    was = _arrived(spark, base).groupBy("id", "seq").agg(F.max_by("reason", F.struct(F.col("reason").isNull())).alias("written"))
    now = outcomes(spark, base)
    return now.join(was, ["id", "seq"]).filter(~F.col("written").eqNullSafe(F.col("reason"))).select("id", "seq", "action", "written", "reason")


def arriving(rows: DataFrame, folder: str, batches: int = 4) -> DataFrame:
    """Stand-in for a feed: ``rows`` written once by the tasks that make them,
    in no useful order, and read as a stream of about ``batches`` micro-batches.
    Rows of fewer tasks than that are dealt out to as many files."""
    spark = rows.sparkSession

    def write(some: DataFrame, name: str) -> str:
        with shuffles_dropped(spark):
            some.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        return f"{folder}/{name}"
    path = write(rows, "rows")
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    if files < batches:
        few, path, files = path, write(spark.read.schema(rows.schema).parquet(path).repartition(batches), "dealt"), batches
        forget(spark, few)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


def run_daily_demand(bookings: DataFrame, base: str, checkpoint: str, every: int = EVERY) -> DataFrame:
    """Streaming A1 over arriving booking rows (booking_date and the three
    segment keys). A micro-batch appends its counts, and the sum over all is
    the demand, in whatever order rows arrive."""
    keys = ["booking_date", *SEGMENT_COLUMNS]
    spark = bookings.sparkSession
    schema = T.StructType([*[bookings.schema[k] for k in keys], T.StructField("n", T.LongType())])

    def log(session: SparkSession) -> MergeLog:
        return MergeLog(session, f"{base}/counts", schema, lambda parts: parts.groupBy(*keys).agg(F.sum("n").alias("n")), every)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        log(batch.sparkSession).append(batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), batch_id)

    q = (bookings.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return log(spark).read().select(*keys, F.col("n").cast("int").alias("demand"))


def score_stream(scored: DataFrame, base: str, checkpoint: str) -> DataFrame:
    """T4: append the scores of arriving rows (any stateless projection of a
    stream) to files."""
    q = (scored.writeStream.format("parquet").option("path", f"{base}/scores")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return scored.sparkSession.read.parquet(f"{base}/scores")


def fresh_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    """Output and checkpoint folders for one run, inside the shared folder.
    They go when the application ends; a stream that is to be resumed names its
    own folders."""
    run = f"{name}-{uuid.uuid4().hex}"
    forget_at_exit(spark, scratch_path(spark, run))
    return scratch_path(spark, run + "/out"), scratch_path(spark, run + "/checkpoint")
