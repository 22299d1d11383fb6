"""Streams equal their batch counterparts, also over several micro-batches."""

import os

from pyspark.sql import functions as F

from conftest import SMALL
from fleetcast.operators.tables import fold_change_log
from fleetcast.sources.snapshots import change_log
from fleetcast.streaming import streams as ST


def _write_parts(spark, ev, tmp_dir, conds):
    src = os.path.join(tmp_dir, "src")
    for i, cond in enumerate(conds):
        (ev.filter(cond).coalesce(1).write.mode("overwrite")
         .parquet(os.path.join(tmp_dir, f"part{i}")))
        f = [x for x in os.listdir(os.path.join(tmp_dir, f"part{i}")) if x.endswith(".parquet")][0]
        os.makedirs(src, exist_ok=True)
        os.link(os.path.join(tmp_dir, f"part{i}", f), os.path.join(src, f"events-{i}.parquet"))
    return src


def test_files_in_any_order_equal_the_batch_fold(spark, tmp_dir):
    # the events table as 6 files, the newest first -> 6 micro-batches
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    n = ev.count()
    q = [n * i // 6 for i in range(7)]
    src = _write_parts(spark, ev, tmp_dir, [(F.col("event_id") >= q[i]) & (F.col("event_id") < q[i + 1]) for i in (4, 1, 5, 0, 3, 2)])
    for i, name in enumerate(sorted(os.listdir(src))):
        os.utime(os.path.join(src, name), (1_600_000_000 + i, 1_600_000_000 + i))
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "events*.parquet").parquet(src))
    out, ckpt = ST.fresh_dirs(spark, "t")
    assert len(ST.apply_change_stream(spark, ST.change_rows(stream), out, ckpt, every=2)) == 6
    got = {r.id: (r.k, r.value, r.last_event, r.last_seq) for r in ST.latest_snapshot(spark, out).collect()}
    want = {r.id: (r.k, r.value, r.last_event, r.last_seq)
            for r in fold_change_log(change_log(spark, SMALL), ["k", "value", "last_event"]).collect()}
    assert got == want
    # a restart on the same checkpoint finds no new input and keeps the state
    assert ST.apply_change_stream(spark, ST.change_rows(stream), out, ckpt, every=2) == [] and ST.latest_snapshot(spark, out).count() == len(want)
    # Every change is an envelope or a reject, and the corrections make both what they are in true order
    events, rejects = spark.read.json(f"{out}/events"), spark.read.parquet(f"{out}/rejects")
    assert events.count() + rejects.count() == n
    written = {(r.id, r.seq): None for r in events.collect()} | {(r.id, r.seq): r.reason for r in rejects.collect()}
    fixed = written | {(r.id, r.seq): r.reason for r in ST.corrections(spark, out).collect()}
    alive, true = set(), {}
    for r in sorted(change_log(spark, SMALL).collect(), key=lambda r: r.seq):
        true[r.id, r.seq] = None if r.action == "create" or r.id in alive else "unknown_id"
        (alive.add if r.action == "create" else alive.discard if r.action == "delete" else lambda x: None)(r.id)
    assert fixed == true and written != true
    assert {(r.id, r.seq): r.reason for r in ST.outcomes(spark, out).collect()} == true


def test_merge_log_stays_small(spark, tmp_dir):
    """Fifty batches: the same files and manifests as after ten, give or take."""
    from fleetcast.streaming.mergelog import MergeLog
    schema = spark.createDataFrame([], "k long, n long").schema
    log = MergeLog(spark, f"{tmp_dir}/log", schema, lambda parts: parts.groupBy("k").agg(F.sum("n").alias("n")), every=3)
    files = []
    for b in range(50):
        part = spark.createDataFrame([(b % 4, 1), (9, 1)], schema).coalesce(1)
        log.append(part, b)
        if b % 7 == 3:
            log.append(part, b)                               # the same batch again
        files.append(sum(len(f) for _, _, f in os.walk(f"{tmp_dir}/log")))
    assert {r.k: r.n for r in log.read().collect()} == {0: 13, 1: 13, 2: 12, 3: 12, 9: 50}
    assert log.manifests() == [48, 49] and len(log.live()) <= 2 * 4
    assert max(files[10:]) <= max(files[:10]) * 3


def _run_batches(spark, tmp_dir, batches, name):
    """The state after micro-batches of (id, seq, action, payload)."""
    schema = "id long, seq long, action string, payload string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_dir}/b{i}")
        f = [x for x in os.listdir(f"{tmp_dir}/b{i}") if x.endswith(".parquet")][0]
        os.makedirs(f"{tmp_dir}/feed", exist_ok=True)
        os.link(f"{tmp_dir}/b{i}/{f}", f"{tmp_dir}/feed/{i}.parquet")
        os.utime(f"{tmp_dir}/feed/{i}.parquet", (1_600_000_000 + i, 1_600_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/feed")
    out, ckpt = ST.fresh_dirs(spark, name)
    ST.apply_change_stream(spark, stream, out, ckpt)
    rejects = {(r.id, r.seq): r.reason for r in spark.read.parquet(f"{out}/rejects").collect()}
    events = {(r.id, r.seq) for r in spark.read.schema("id long, seq long").json(f"{out}/events").collect()}
    return {r.id: (r.k, r.value) for r in ST.latest_snapshot(spark, out).collect()}, rejects, events


def test_deleted_ids_stay_deleted(spark, tmp_dir):
    state, rejects, events = _run_batches(spark, tmp_dir, [
        [(1, 1, "create", '{"k":"a"}'), (1, 5, "delete", None), (2, 2, "create", '{"k":"b"}')],
        [(1, 3, "create", '{"k":"late"}'), (7, 6, "update", '{"k":"nobody"}')],
        [(2, 8, "update", '{"value":"4"}'), (1, 9, "update", '{"k":"gone"}'), (3, 7, "delete", None)],
        [(1, 10, "create", '{"k":"again"}')]], "tombstone")
    assert state == {1: ("again", None), 2: ("b", "4")}
    assert rejects == {(7, 6): "unknown_id", (1, 9): "unknown_id", (3, 7): "unknown_id"}
    assert events == {(1, 1), (1, 5), (2, 2), (2, 8), (1, 10), (1, 3)}


def test_batch_borders_and_order_do_not_matter(spark, tmp_dir):
    import random
    rng, rows = random.Random(7), []
    for seq in range(1, 61):
        action = rng.choice(["create", "update", "update", "delete"])
        rows.append((rng.randint(1, 5), seq, action, None if action == "delete" else '{"k":"%d"}' % seq))
    folded = fold_change_log(spark.createDataFrame(rows, "id long, seq long, action string, payload string"), ["k", "value"])
    want = {r.id: (r.k, r.value) for r in folded.collect()}
    for n, (size, shuffled) in enumerate([(60, False), (12, True), (9, True)]):
        mine = rng.sample(rows, len(rows)) + rows[:3] if shuffled else rows            # some arrive twice
        parts = [mine[i:i + size] for i in range(0, len(mine), size)]
        os.makedirs(f"{tmp_dir}/{n}", exist_ok=True)
        assert _run_batches(spark, f"{tmp_dir}/{n}", parts, f"borders-{n}")[0] == want


def test_daily_demand_stream_equals_batch(spark):
    from fleetcast.operators.demand import daily_segment_counts
    from fleetcast.sources.tables import load_history, segment_history
    out, ckpt = ST.fresh_dirs(spark, "d")
    keys = ["booking_date", "from_area_id", "vehicle_model_id", "travel_type_id"]
    rows = load_history(segment_history(spark, SMALL))
    got = ST.run_daily_demand(ST.arriving(rows, f"{out}/feed", 6), out, ckpt)
    want = daily_segment_counts(rows)
    assert got.select(*keys, "demand").exceptAll(want.select(*keys, "demand")).count() == 0
    assert want.exceptAll(got.select(*keys, "demand")).count() == 0


def test_a_feed_is_computed_once(spark, tmp_dir):
    """Its rows are written by the tasks that make them: not computed for a
    count of partitions first, nor dealt out again."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.range(900).mapInArrow(run, "id long").repartition(9)
    feed = ST.arriving(rows, f"{tmp_dir}/feed", 3)
    assert seen.value == 900
    sizes = []
    q = (feed.writeStream.foreachBatch(lambda b, i: sizes.append(b.count())).option("checkpointLocation", f"{tmp_dir}/c")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(sizes) == 900 and len(sizes) == 3
    few = ST.arriving(spark.range(8).coalesce(1), f"{tmp_dir}/few", 4)
    assert os.listdir(f"{tmp_dir}/few") == ["dealt"] and few.isStreaming


def test_scored_feed_goes_when_its_scores_are_written(spark):
    from fleetcast.plans import queries as Q
    from fleetcast.session import checkpoint_dir
    top = checkpoint_dir(spark).removeprefix("file:")
    old = set(os.listdir(top))
    scores = Q.QUERIES["stream_score"](spark, SMALL)
    (run,) = [d for d in set(os.listdir(top)) - old if d.startswith("stream-score")]
    assert os.listdir(f"{top}/{run}/out") == ["scores"]
    assert scores.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
