"""Scalar functions: coercion, calendar, holidays, distance, rounding."""

import datetime as dt
import math

from pyspark.sql import functions as F

from fleetcast.functions import calendar as C
from fleetcast.functions import coerce as K
from fleetcast.operators.features import haversine_km
from fleetcast.operators.forecast import clip_round
from fleetcast.operators.models import risk_index


def one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_to_int_default_truncates_and_defaults(spark):
    got = one(spark, K.to_int_default("x"), [("9.5",), ("-9.5",), ("abc",), (None,), ("3",)])
    assert got == [9, -9, 0, 0, 3]


def test_to_number_and_finite(spark):
    got = one(spark, K.finite_or_null(K.to_number("x")),
              [("1.5",), ("inf",), ("-Infinity",), ("NaN",), ("x",)])
    assert got == [1.5, None, None, None, None]


def test_timestamp_formats(spark):
    got = one(spark, K.to_timestamp_any("x"),
              [("1/5/2013 7:05",), ("01/05/2013 07:05",), ("2013-01-05T07:05:00",),
               ("2013-01-05 07:05:00",), ("bad",)])
    want = dt.datetime(2013, 1, 5, 7, 5)
    assert got[:4] == [want] * 4 and got[4] is None
    assert one(spark, K.to_timestamp_export("x"), [("12/31/2013 23:59",)]) == \
        [dt.datetime(2013, 12, 31, 23, 59)]


def test_falsy_default(spark):
    got = one(spark, K.falsy_default("x", "d"), [("",), (None,), ("v",)])
    assert got == ["d", "d", "v"]


def test_haversine_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 180.0),
                                (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km("a", "b", "c", "d")).collect()]
    assert got[0] == 0.0
    assert abs(got[1] - math.pi * 6371.0) < 1e-6
    assert got[2] is None


def test_calendar_edges(spark):
    days = [dt.date(2020, 12, 31), dt.date(2021, 1, 1), dt.date(2020, 2, 29),
            dt.date(2021, 3, 31), dt.date(2021, 4, 1), dt.date(2021, 1, 15)]
    df = spark.createDataFrame([(d,) for d in days], "booking_date date")
    rows = df.select("booking_date", *C.calendar_columns()).collect()
    by = {r.booking_date: r for r in rows}
    assert by[dt.date(2020, 12, 31)].weekofyear == 53
    assert by[dt.date(2021, 1, 1)].weekofyear == 53
    assert by[dt.date(2021, 1, 1)].dayofweek == 4          # Friday, Monday = 0
    assert by[dt.date(2020, 2, 29)].dayofyear == 60
    assert by[dt.date(2021, 3, 31)].is_quarter_end == 1
    assert by[dt.date(2021, 4, 1)].is_quarter_start == 1
    assert by[dt.date(2021, 1, 15)].is_payday == 1


def test_holidays_equal_pandas_calendar(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar
    lo, hi = "1991-01-01", "2029-12-31"
    got = {r[0] for r in C.holiday_calendar(F.lit(lo).cast("date"), F.lit(hi).cast("date"),
                                             spark).collect()}
    want = {d.date() for d in USFederalHolidayCalendar().holidays(lo, hi)}
    assert got == want


def test_holiday_outside_range_does_not_flag(spark):
    # 2013-07-04 is a holiday; a range ending 07-03 must not flag 07-03
    df = spark.createDataFrame([(dt.date(2013, 6, 20),), (dt.date(2013, 7, 3),)],
                               "booking_date date")
    rows = {r.booking_date: r for r in C.add_holiday_flags(df).collect()}
    assert rows[dt.date(2013, 7, 3)].is_holiday_window == 0
    # a Saturday holiday is observed on the Friday before
    df2 = spark.createDataFrame([(dt.date(2020, 7, 1),), (dt.date(2020, 7, 3),),
                                 (dt.date(2020, 7, 6),)], "booking_date date")
    rows2 = {r.booking_date: r for r in C.add_holiday_flags(df2).collect()}
    assert rows2[dt.date(2020, 7, 3)].is_holiday == 1


def test_round_half_even_and_clip(spark):
    got = one(spark, clip_round(F.col("x")), [(2.5,), (3.5,), (-4.0,), (0.49,)], "x double")
    assert got == [2, 4, 0, 0]
    assert one(spark, risk_index(F.col("x")), [(0.0,), (1.0,), (0.5,)], "x double") == [20, 5, 12]


def test_feature_frame_edge_rows(spark):
    from fleetcast.operators.features import FEATURE_COLUMNS, prepare_features
    raw = spark.createDataFrame([
        # text in a numeric column, '3.7' id, created after start (negative lead)
        ("abc", "3.7", "10.0", "20.0", "10.0", "20.0", "1/5/2013 10:00", "1/5/2013 16:00",
         "1/6/2013 10:00"),
        # unparsable date, infinite coordinate, antipodal-ish route
        ("1", "2", "inf", "0", "0", "180", "not a date", "2013-01-05 16:00:00",
         "2013-01-04 10:00:00"),
    ], "vehicle_model_id string, package_id string, from_lat string, from_long string, "
       "to_lat string, to_long string, from_date string, to_date string, "
       "booking_created string")                       # 'to_city_id' etc. absent
    rows = prepare_features(raw).collect()
    a, b = rows
    assert list(rows[0].asDict()) == FEATURE_COLUMNS
    assert a.vehicle_model_id is None and a.package_id == 3.7
    assert a.booking_lead_hours == -24.0 and a.trip_duration_hours == 6.0
    assert a.route_distance_km == 0.0 and a.to_city_id is None
    assert a.booking_created_dayofweek == 6.0 and a.from_date_hour == 10.0
    assert b.from_lat is None and b.route_distance_km is None
    assert b.booking_lead_hours is None and b.from_date_hour is None


def test_timestamp_texts_are_parsed_once_by_their_shape(spark):
    """Same answers as trying every format in turn; each date column is parsed in one place."""
    from fleetcast.functions import coerce as C
    from fleetcast.operators import features as G
    texts = ["2024-02-03T04:05:06.123456", "2024-02-03T04:05:06", "2024-02-03t04:05:06", "2024-02-03T04:05", "2024-02-03 04:05:06.5", "2024-02-03 04:05:06",
             "2024-02-03 04:05", "2024-02-03", "2/3/2024 4:05", "02/03/2024 04:05", "2/3/2024", "+12024-02-03", "-2024-02-03", "2024-2-3", " 2024-02-03",
             "2024-02-30", "24-02-03", "0000-01-01", "99/99/2024", "2024-02-03 24:00:00", "--", "- :", "//", "", "x", None, "2024-02-03T04:05:06Z", "٢٠٢٤-02-03"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in C.TIMESTAMP_FORMATS])
    got = rows.select("t", C.to_timestamp_any("t").cast("string").alias("now"), each.cast("string").alias("each")).collect()
    assert [(r.t, r.now) for r in got] == [(r.t, r.each) for r in got] and sum(r.now is not None for r in got) >= 11
    raw = spark.createDataFrame([("2024-02-03 04:05:06",) * 3], "from_date string, to_date string, booking_created string")
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = G.prepare_features(raw.repartition(1))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    assert plan.count("M/d/yyyy H:mm") == 6         # by shape and otherwise, for each of three columns
