"""Sources and sinks: CSV, JSON changes, forecast CSV, profile, snapshots."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fleetcast.operators.features import FEATURE_COLUMNS, prepare_features
from fleetcast.plans.output import presentable
from fleetcast.sources import io as IO
from fleetcast.sources import snapshots as SN
from fleetcast.sources.tables import booking_history


def test_csv_text_round_trip_gives_same_features(spark, tmp_dir):
    typed = booking_history(spark, SMALL)
    text = typed.select(*[F.col(c).cast("string").alias(c) for c in IO.BOOKING_CSV_COLUMNS],
                        "order_key", "line_number")
    path = os.path.join(tmp_dir, "bookings_csv")
    text.write.option("header", True).csv(path)
    raw = IO.read_booking_csv(spark, path, required=["Car_Cancellation"])
    a = prepare_features(raw, keep=["order_key", "line_number"])
    b = prepare_features(typed, keep=[F.col("order_key").cast("string"),
                                      F.col("line_number").cast("string")])
    r = lambda df: df.select([F.round(c, 6).alias(c) if c in FEATURE_COLUMNS else c
                              for c in df.columns])
    assert r(a).exceptAll(r(b)).count() == 0



def test_missing_columns_error_is_sorted(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    spark.createDataFrame([("1",)], "a string").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="b, c"):
        IO.read_booking_csv(spark, path, required=["c", "b", "a"])


def test_csv_columns_are_bound_by_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "n.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,2,3\n")
    assert IO.read_booking_csv(spark, path, columns=["c", "a"]).first().asDict() == {"c": "3", "a": "1"}
    with pytest.raises(ValueError):
        IO.read_booking_csv(spark, path, columns=["d"])


def test_csv_folder_with_different_headers_fails(spark, tmp_dir):
    for name, text in (("x", "a,b\n1,2\n"), ("y", "b,a\n3,4\n")):
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="(?i)header"):
        IO.read_booking_csv(spark, tmp_dir).collect()


def test_forecast_sink_keeps_series_apart(spark, tmp_dir):
    import datetime as dt
    fc = spark.createDataFrame([(s, dt.date(2013, 1, 1), 1.0, 0.5, 1.5) for s in ("x", "y")],
                               "series_id string, ds date, yhat double, yhat_lower double, yhat_upper double")
    IO.write_forecast_csv(fc, os.path.join(tmp_dir, "s"))
    assert sorted(x for x in os.listdir(os.path.join(tmp_dir, "s")) if "=" in x) == ["series_id=x", "series_id=y"]


def test_json_changes_split_rejects(spark, tmp_dir):
    p = os.path.join(tmp_dir, "changes.json")
    with open(p, "w") as f:
        f.write('{"entity":"user","action":"create","id":1,"seq":1,"payload":"{}"}\n')
        f.write('{not json\n')
    ok, bad = IO.read_changes_json(spark, p)
    assert ok.count() == 1 and bad.count() == 1


def test_forecast_csv_sink_columns(spark, tmp_dir):
    import datetime as dt
    fc = spark.createDataFrame([(dt.date(2013, 1, 1), 1.0, 0.5, 1.5, 2.0)],
                               "ds date, yhat double, yhat_lower double, yhat_upper double, y double")
    IO.write_forecast_csv(fc, os.path.join(tmp_dir, "f"))
    IO.write_forecast_csv(fc, os.path.join(tmp_dir, "h"), holdout=True)
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "f")).columns == \
        ["Date", "Forecast", "Lower_Bound", "Upper_Bound"]
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "h")).columns == \
        ["Date", "Actual", "Predicted", "Lower_Bound", "Upper_Bound"]


def test_profile_schema_metrics_and_empty_snapshot(spark, tmp_dir):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    prof = {r.column: r for r in IO.profile(li, quartiles=True).collect()}
    assert prof["l_quantity"]["count"] == li.count() and prof["l_quantity"]["q50"] is not None
    assert IO.schema_table(li).count() == len(li.columns)
    m = spark.createDataFrame([(0.5, 10)], "f1 double, rows int")
    assert IO.metrics_json(m).first()[0] == '{"f1":0.5,"rows":10}'
    empty = SN.read_snapshot(spark, os.path.join(tmp_dir, "nope"), "users")
    assert empty.count() == 0 and empty.columns[0] == "id"


def test_booking_csv_is_written_compressed(spark, monkeypatch):
    """Text takes several times the space of the tables it is made of."""
    from fleetcast.plans import queries as Q
    made = booking_history(spark, SMALL).limit(300).localCheckpoint()
    monkeypatch.setattr(Q, "booking_history", lambda *a: made)
    out = Q.QUERIES["csv_booking_features"](spark, SMALL)
    assert all(f.endswith(".csv.gz") for f in out.inputFiles()) and out.inputFiles()
    want = presentable(prepare_features(made, keep=["order_key", "line_number"]))
    assert out.select(*want.columns).exceptAll(want).count() == 0 and out.count() == 300


def test_line_items_move_by_three_keys(spark):
    """Where no table can be broadcast, bookings are dealt out by order, part
    and supplier; customers are met by the orders."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan, wide = booking_history(spark, SMALL)._jdf.queryExecution().executedPlan(), 0
        nodes = [plan]
        while nodes:
            n = nodes.pop()
            nodes += [n.children().apply(i) for i in range(n.children().size())]
            wide += n.nodeName() == "Exchange" and "l_linenumber" in n.output().toString()
        assert wide == 3
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
