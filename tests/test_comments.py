"""Comments as rows: equal to the arrays, retried batches, a hot report."""

import json

from pyspark.sql import functions as F

from conftest import SMALL
from fleetcast.operators import comments as C
from fleetcast.operators import tables as TB
from fleetcast.plans import queries as Q
from fleetcast.sources import snapshots as SN


def test_rows_give_the_same_arrays(spark, tmp_dir):
    reports, batch = SN.logreports(spark, SMALL), Q._new_comments(spark, SMALL)
    path = f"{tmp_dir}/c"
    C.write_comments(C.stored_comments(reports), path)
    for _ in range(2):                                     # a retried batch
        C.write_comments(C.new_comments(reports, batch, 1)[0], path)
    got = C.with_comments(reports, C.read_comments(spark, path))
    want = TB.append_comments(reports, batch)
    assert {r.id: json.loads(r.comments) for r in got.collect()} == {r.id: json.loads(r.comments) for r in want.collect()}


def test_hot_report_is_spread_and_rejects(spark, tmp_dir):
    reports = SN.conform(spark.createDataFrame([(i, "[]") for i in range(20)], "id long, comments string"), "logreports")
    batch = spark.range(20000).select(
        F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") % 30).cast("long").alias("report_id"), F.col("id").alias("seq"),
        F.lit("a").alias("author"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), F.lit("").alias("extra"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh, rejects = C.new_comments(reports, batch, 3)
        sizes = [r["count"] for r in fresh.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.5 * sum(sizes) and len(sizes) >= 4       # 90 % are of one report
        assert "collect_list" not in fresh._jdf.queryExecution().executedPlan().toString()
        assert {r.id for r in rejects.collect()} == {20} and rejects.count() + fresh.count() == 20000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    page = C.newest_comments(fresh, 3).filter("report_id = 7").orderBy("rank").collect()
    assert [r.seq for r in page] == [19999, 19998, 19997]
    top = {r.report_id: r for r in C.comment_totals(fresh).collect()}
    assert top[7].n_comments == 18000


def test_odd_rows(spark, tmp_dir):
    reports = SN.conform(spark.createDataFrame([(1, None), (2, ""), (3, "not json"), (4, '[{"author":"x","message":"y"}]')],
                                               "id long, comments string"), "logreports")
    assert [(r.report_id, r.seq, r.author) for r in C.stored_comments(reports).collect()] == [(4, 0, "x")]
    batch = spark.createDataFrame([(1, 1, None, None), (None, 2, "b", "t"), (1, 1, None, None)],
                                  "report_id long, seq long, author string, message string")
    fresh, rejects = C.new_comments(reports, batch, 1)
    assert [tuple(r) for r in fresh.collect()] == [(1, 1, "Anonymous", "", "", 1)] * 2
    assert [tuple(r) for r in rejects.collect()] == [(None, 2, "unknown_report")]
    assert C.newest_comments(fresh.limit(0)).count() == 0 and C.comment_totals(fresh.limit(0)).count() == 0
    assert {r.id: r.comments for r in C.with_comments(reports, fresh.limit(0)).collect()} == dict.fromkeys([1, 2, 3, 4], "[]")
