"""Demand grid, windows and split: properties and small fixtures."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from fleetcast.operators import demand as D
from fleetcast.sources.tables import load_history, segment_history


def test_grid_is_days_times_segments_and_keeps_every_booking(spark):
    hist = load_history(segment_history(spark, SMALL))
    counts = D.daily_segment_counts(hist)
    grid = D.dense_grid(counts)
    b = counts.agg(F.min("booking_date"), F.max("booking_date")).first()
    days = (b[1] - b[0]).days + 1
    segs = counts.select(*D.SEGMENT_COLUMNS).distinct().count()
    assert grid.count() == days * segs
    assert grid.agg(F.sum("demand")).first()[0] == hist.count()


def test_lags_and_rolling_equal_pandas(spark):
    days = pd.date_range("2020-01-01", periods=40, freq="D")
    rows = [(d.date(), 1, 2, 3, int((i * 7) % 11)) for i, d in enumerate(days)]
    rows += [(d.date(), 9, 9, 9, int((i * 3) % 5)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "booking_date date, from_area_id int, vehicle_model_id int, "
                                     "travel_type_id int, demand int")
    got = D.add_lag_features(df).toPandas().sort_values(
        ["from_area_id", "booking_date"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["d", "a", "v", "t", "demand"]).sort_values(["a", "d"])
    g = pdf.groupby("a")["demand"]
    shifted = g.shift(1)
    exp_lag28 = g.shift(28).reset_index(drop=True)
    exp_rm14 = shifted.groupby(pdf["a"]).transform(
        lambda s: s.rolling(14, min_periods=1).mean()).reset_index(drop=True)
    exp_sd7 = shifted.groupby(pdf["a"]).transform(
        lambda s: s.rolling(7, min_periods=2).std()).reset_index(drop=True)
    pd.testing.assert_series_equal(got["lag_28"].astype(float), exp_lag28.astype(float),
                                   check_names=False)
    pd.testing.assert_series_equal(got["rolling_mean_14"], exp_rm14, check_names=False)
    pd.testing.assert_series_equal(got["rolling_std_7"], exp_sd7, check_names=False)


def test_split_needs_ten_dates(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, d),) for d in range(1, 6)], "booking_date date")
    with pytest.raises(Exception, match="too_few_dates"):
        df.filter(F.col("booking_date") <= D.split_date(df)).count()


def test_split_cut_is_kth_date(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, d),) for d in range(1, 21)], "booking_date date")
    cut = df.select(D.split_date(df).alias("c")).first()["c"]
    assert cut == dt.date(2020, 1, 16)          # k = int(0.8 * 20) = 16


def test_target_means_levels(spark):
    df = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 1, 4), (2, 1, 1, 6)],
                               "from_area_id int, vehicle_model_id int, travel_type_id int, demand int")
    m = {(r.level, r.from_area_id, r.vehicle_model_id, r.travel_type_id): r.mean_demand
         for r in D.target_means(df).collect()}
    assert m[("global", None, None, None)] == 4.0
    assert m[("area", 1, None, None)] == 3.0
    assert m[("vehicle_model", None, 1, None)] == 4.0
    assert m[("segment", 2, 1, 1)] == 6.0
    out = D.add_static_features(
        spark.createDataFrame([(3, 3, 3)], "from_area_id int, vehicle_model_id int, travel_type_id int"),
        D.target_means(df)).first()
    assert out.segment_mean_demand == 4.0 and out.area_mean_demand == 4.0   # unseen -> global


def test_grid_fills_late_and_single_row_segments(spark):
    rows = [(dt.date(2020, 1, 1), 1, 1, 1), (dt.date(2020, 1, 10), 1, 1, 1),
            (dt.date(2020, 1, 8), 2, 2, 2)]                   # starts late, one row
    h = spark.createDataFrame(rows, "booking_date date, from_area_id int, vehicle_model_id int, "
                                    "travel_type_id int")
    g = D.dense_grid(D.daily_segment_counts(h))
    seg2 = g.filter("from_area_id = 2").orderBy("booking_date").collect()
    assert len(seg2) == 10 and seg2[0].demand == 0 and seg2[7].demand == 1


def test_load_history_coerces_keys_and_drops_undated(spark):
    raw = spark.createDataFrame(
        [("2013-01-05 10:00:00", "3.7", "x", None), ("bad date", "1", "1", "1"),
         ("1/6/2013 9:30", "-2.5", "2", "3")],
        "booking_created string, from_area_id string, vehicle_model_id string, "
        "travel_type_id string")
    raw = raw.withColumn("booking_created",
                         __import__("fleetcast.functions.coerce", fromlist=["x"])
                         .to_timestamp_any("booking_created"))
    got = sorted(tuple(r) for r in load_history(raw).collect())
    assert got == [(dt.date(2013, 1, 5), 3, 0, 0), (dt.date(2013, 1, 6), -2, 2, 3)]
    with pytest.raises(ValueError, match="from_area_id, travel_type_id"):
        load_history(raw.drop("from_area_id", "travel_type_id"))
