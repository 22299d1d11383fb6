"""Driver queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's tables in full and composes operators from
``fleetcast.operators`` / ``fleetcast.functions``. The matching DuckDB SQL is
in ``fleetcast.plans.oracle``; column names and types are kept equal.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcast.functions.calendar import add_holiday_flags, calendar_columns, cyclic_columns
from fleetcast.operators import boosting as BT
from fleetcast.operators import comments as CM
from fleetcast.operators import demand as D
from fleetcast.plans.output import presentable
from fleetcast.session import forget, materialize, scratch_tables, shuffles_dropped
from fleetcast.sources import layout as LY
from fleetcast.sources.tables import SEGMENT_COLUMNS, load_history, segment_history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _history(spark, sf):
    return load_history(segment_history(spark, sf))


def _counts(spark, sf):
    return D.segment_counts_table(_history(spark, sf))


def _grid(spark, sf):
    return D.dense_grid(_counts(spark, sf))


# ---- demand series -----------------------------------------------------------

@query
def q_daily_demand(spark, sf):
    """A2 + C5 + O2: bookings per day."""
    s = D.daily_totals(_history(spark, sf))
    return presentable(s.select(F.col("ds").alias("booking_date"),
                                F.col("y").cast("long").alias("bookings"))
                       .orderBy("booking_date"))


@query
def q_daily_segment_demand(spark, sf):
    """A1: bookings per day and segment."""
    return presentable(D.daily_segment_counts(_history(spark, sf)))


@query
def q_series_summary(spark, sf):
    """A12 + A3: describe() of the daily series, with its date range."""
    s = D.daily_totals(_history(spark, sf))
    return presentable(s.agg(
        F.count("y").alias("days"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"),
        F.min("y").alias("min"),
        F.percentile("y", 0.25).alias("q25"),
        F.percentile("y", 0.5).alias("q50"),
        F.percentile("y", 0.75).alias("q75"),
        F.max("y").alias("max"),
        F.min("ds").alias("first_date"),
        F.max("ds").alias("last_date"),
    ))


@query
def q_dense_grid(spark, sf):
    """J1 + J2 + A5: zero-filled date x segment grid."""
    return presentable(_grid(spark, sf))


@query
def q_demand_lags(spark, sf):
    """Lags 1, 7, 14, 28 per segment."""
    g = D.add_lag_features(_grid(spark, sf))
    return presentable(g.select("booking_date", *SEGMENT_COLUMNS, "demand",
                                *[f"lag_{k}" for k in D.LAG_FEATURES]))


@query
def q_demand_rolling(spark, sf):
    """W2 + W3: rolling means of the previous 7/14/28 days, rolling std 7."""
    g = D.add_lag_features(_grid(spark, sf))
    return presentable(g.select("booking_date", *SEGMENT_COLUMNS, "demand",
                                *[f"rolling_mean_{k}" for k in D.ROLLING_WINDOWS],
                                "rolling_std_7"))


@query
def q_target_means(spark, sf):
    """A4 on the training days of the grid (W4 cut)."""
    g = _grid(spark, sf)
    train = g.filter(F.col("booking_date") <= D.split_date(g))
    return presentable(D.target_means(train))


@query
def q_target_mean_lookup(spark, sf):
    """J3 + J4: static mean features for every grid row, from training means."""
    g = _grid(spark, sf)
    train = g.filter(F.col("booking_date") <= D.split_date(g))
    out = D.add_static_features(g, D.target_means(train))
    return presentable(out.select("booking_date", *SEGMENT_COLUMNS, "demand", *D.STATIC_FEATURES))


def _calendar_days(spark, sf):
    """Distinct days of the grid's range (the date axis of G2)."""
    counts = _counts(spark, sf)
    b = D.date_bounds(counts)
    return spark.range(1).select(
        F.explode(F.sequence(b.getField("lo"), b.getField("hi"))).alias("booking_date"))


@query
def q_calendar_features(spark, sf):
    """C10-C12 per day."""
    d = _calendar_days(spark, sf)
    return presentable(d.select("booking_date", *calendar_columns()))


@query
def q_cyclic_features(spark, sf):
    """C13 per day."""
    d = _calendar_days(spark, sf)
    return presentable(d.select("booking_date", *cyclic_columns()))


@query
def q_holiday_flags(spark, sf):
    """C14 + O4 + J5 per day."""
    d = _calendar_days(spark, sf)
    return presentable(add_holiday_flags(d))


@query
def q_demand_feature_frame(spark, sf):
    """The full 32-column demand feature frame."""
    return presentable(D.build_demand_features(_history(spark, sf)))


@query
def q_date_split(spark, sf):
    """W4 + A6 + F7 + A17: chronological 80/20 split of the grid by date."""
    g = _grid(spark, sf)
    cut = D.split_date(g)
    part = F.when(F.col("booking_date") <= cut, "train").otherwise("test")
    return presentable(g.groupBy(part.alias("split")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("booking_date").alias("days"),
        F.min("booking_date").alias("first_date"),
        F.max("booking_date").alias("last_date"),
        F.sum("demand").cast("long").alias("demand")))


@query
def q_series_split(spark, sf):
    """Positional 80/20 split of the daily series (no max(1, .))."""
    s = D.daily_totals(_history(spark, sf))
    cut = D.split_date(s, "ds", min_dates=0, at_least_one=False)
    part = F.when(F.col("ds") <= cut, "train").otherwise("test")
    return presentable(s.groupBy(part.alias("split")).agg(
        F.count(F.lit(1)).alias("days"),
        F.min("ds").alias("first_date"),
        F.max("ds").alias("last_date"),
        F.sum("y").alias("bookings")))


# ---- booking features, coercion, training preparation ---------------------------

from fleetcast.functions.coerce import (  # noqa: E402
    finite_or_null, to_day, to_int_default, to_number, to_timestamp_any, to_timestamp_export)
from fleetcast.operators import features as G  # noqa: E402
from fleetcast.operators import metrics as M  # noqa: E402
from fleetcast.operators import training as L  # noqa: E402
from fleetcast.sources.tables import booking_history, read_table  # noqa: E402

BOOKING_KEYS = ["order_key", "line_number", "part_key", "supp_key"]
LABEL = "Car_Cancellation"


def _features(spark, sf):
    """F2 + G1: booking rows with a label -> 22 features, keys and label."""
    raw = booking_history(spark, sf).filter(F.col(LABEL).isNotNull())
    return G.prepare_features(raw, keep=[*BOOKING_KEYS, F.col(LABEL).cast("int").alias("label")])


def _split_features(spark, sf):
    """Booking features with their split. Every line item is a booking, so the
    split's cuts come from line items alone."""
    keys = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return L.stratified_split(_features(spark, sf), "label", BOOKING_KEYS, keys=keys)


def risk_rule(lead_hours_col="booking_lead_hours"):
    """Rule-based cancellation score used where no trained model is involved:
    bookings made long in advance score low, late or back-dated ones high."""
    return 1.0 / (1.0 + F.exp(F.col(lead_hours_col) / F.lit(8760.0)))


@query
def q_booking_features(spark, sf):
    """G1 + C6-C9 + P6: the 22-column feature frame for every booking."""
    return presentable(_features(spark, sf))


@query
def q_route_distance(spark, sf):
    """Great-circle distance of every route in the embeddings table."""
    e = read_table(spark, sf, "embeddings")
    lat = [F.element_at("embedding", i).cast("double") * s
           for i, s in [(1, 90.0), (2, 180.0), (3, 90.0), (4, 180.0)]]
    return presentable(e.select(
        "vec_id", G.haversine_km(*lat).alias("route_distance_km")))


@query
def q_coerce_numbers(spark, sf):
    """C1 + C2 + C9: text to double / int with bad values -> null / 0."""
    o = read_table(spark, sf, "orders")
    price_text = F.col("o_totalprice").cast("string")
    return presentable(o.select(
        "o_orderkey",
        finite_or_null(to_number(F.substring("o_orderpriority", 1, 1))).alias("priority_code"),
        finite_or_null(to_number("o_orderpriority")).alias("priority_text"),
        finite_or_null(to_number(price_text)).alias("price"),
        to_int_default(price_text).alias("price_int"),
        to_int_default("o_orderstatus").alias("status_int"),
    ))


@query
def q_coerce_timestamps(spark, sf):
    """C3 + C4 + C5 + F1: timestamp text in ISO and export formats."""
    ev = read_table(spark, sf, "events")
    iso_text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    export_text = F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy H:mm")
    out = ev.select(
        "event_id",
        to_timestamp_any(iso_text).alias("ts_iso"),
        to_timestamp_export(export_text).alias("ts_export"),
        to_timestamp_any(F.col("event_type")).alias("ts_bad"),
    ).withColumn("event_date", to_day("ts_iso")).filter(F.col("event_date").isNotNull())
    return presentable(out)


@query
def q_stratified_split(spark, sf):
    """L1: stratified 80/20 split, per split and class."""
    s = _split_features(spark, sf)
    return presentable(s.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("booking_lead_hours").alias("lead_hours"),
        F.sum("order_key").alias("order_keys")))


@query
def q_median_impute(spark, sf):
    """Medians of the 22 features on the training split, and how many
    nulls each fills over the whole frame."""
    s = _split_features(spark, sf)
    med = L.median_values(s.filter(F.col("split") == "train"), G.FEATURE_COLUMNS)
    nulls = s.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in G.FEATURE_COLUMNS])
    m = med.unpivot([], G.FEATURE_COLUMNS, "feature", "median")
    n = nulls.unpivot([], G.FEATURE_COLUMNS, "feature", "filled")
    return presentable(m.join(n, "feature"))


@query
def q_class_weights(spark, sf):
    """Balanced class weights on the training split."""
    s = _split_features(spark, sf).filter(F.col("split") == "train")
    return presentable(L.class_weights(s, "label"))


def _rule_scored_test(spark, sf):
    s = _split_features(spark, sf).filter(F.col("split") == "test")
    return s.select("label", risk_rule().alias("score")).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int"))


@query
def q_classification_metrics(spark, sf):
    """A10 + A17 on the test split with the rule score."""
    return presentable(M.classification_metrics(_rule_scored_test(spark, sf)))


@query
def q_roc_auc(spark, sf):
    """Exact ROC AUC of the rule score on the test split."""
    return presentable(M.roc_auc(_rule_scored_test(spark, sf)))


# ---- forecasts, hold-out evaluation, demand requests ------------------------------

from fleetcast.operators import forecast as FC  # noqa: E402
from fleetcast.session import forget_at_exit, scratch_path  # noqa: E402


def _total_series(spark, sf):
    return D.daily_totals(_history(spark, sf))


def _naive_eval(spark, sf):
    """Observed series, its dense form, one-step seasonal-naive forecast and
    the W4 cut date."""
    s = _total_series(spark, sf)
    dense = FC.dense_series(s)
    prev = dense.select("series_id", F.date_add("ds", FC.SEASON_DAYS).alias("ds"),
                        F.col("y").alias("yhat"))
    fc = s.join(prev, ["series_id", "ds"])
    cut = D.split_date(s, "ds")
    return s, dense, fc, cut


@query
def q_forecast_metrics(spark, sf):
    """A7 + A8 + A9 + F7: hold-out MAE, RMSE, MAPE, R2 of the seasonal-naive
    forecast on the test days."""
    _, _, fc, cut = _naive_eval(spark, sf)
    return presentable(M.regression_metrics(fc.filter(F.col("ds") > cut)))


@query
def q_holdout_table(spark, sf):
    """G9 + J7 + G4 + P7: test days with actual, forecast and 95% bounds
    (sigma from the training residuals), in the CSV column names."""
    _, _, fc, cut = _naive_eval(spark, sf)
    # one series: its training residual std is a scalar subquery
    sigma = FC.residual_std(fc.filter(F.col("ds") <= cut)).agg(F.max("sigma")).scalar()
    out = FC.with_bounds(fc.filter(F.col("ds") > cut), sigma)
    return presentable(out.select(
        F.col("ds").alias("Date"), F.col("y").cast("long").alias("Actual"),
        F.col("yhat").alias("Predicted"), F.col("yhat_lower").alias("Lower_Bound"),
        F.col("yhat_upper").alias("Upper_Bound")))


def _future_naive(spark, sf, periods=30):
    s = _total_series(spark, sf)
    dense = FC.dense_series(s)
    return s, FC.seasonal_naive(dense, FC.future_days(s, periods))


@query
def q_forecast_summary(spark, sf):
    """G6 + F8 + A13: 30-day outlook after the last observed day."""
    _, fut = _future_naive(spark, sf)
    return presentable(M.forecast_summary(fut))


@query
def q_forecast_vs_history(spark, sf):
    """G7 + A14: forecast mean against history mean, percent change."""
    s, fut = _future_naive(spark, sf)
    h = s.agg(F.avg("y").alias("history_mean"))
    f = fut.agg(F.avg("yhat").alias("forecast_mean"))
    hm, fm = h.scalar(), f.scalar()
    return presentable(spark.range(1).select(
        hm.alias("history_mean"), fm.alias("forecast_mean"),
        (F.try_divide(fm - hm, hm) * 100).alias("pct_change")))


def _segment_requests(counts):
    """Demand requests derived from the data: one per segment and one per
    (area, model) over all travel types (null travel type, F10), each for
    the 30 days after the last booking day."""
    a, v, t = SEGMENT_COLUMNS
    last = D.date_bounds(counts).getField("hi")
    seg = counts.select(a, v, t).distinct()
    both = seg.unionByName(seg.select(a, v, F.lit(None).cast("int").alias(t)).distinct())
    return both.select(
        F.concat_ws("-", F.col(a), F.col(v), F.coalesce(F.col(t).cast("string"), F.lit("all")))
        .alias("request_id"), a, v, t,
        F.date_add(last, 1).alias("start_date"), F.date_add(last, 30).alias("end_date"))


# Fixed value: the answer text of a successful demand request.
ANSWER_MESSAGE = "Demand forecast generated successfully"


def _answer(rows):
    """Per-day rows plus the request totals (joined back)."""
    tot = rows.groupBy("request_id").agg(
        F.sum("predicted_bookings").cast("long").alias("total_predicted_bookings"),
        F.count(F.lit(1)).alias("number_of_days"))
    return rows.join(tot, "request_id").select(
        "request_id", F.date_format("ds", "yyyy-MM-dd").alias("date"), "predicted_bookings",
        "total_predicted_bookings", "number_of_days", F.lit(ANSWER_MESSAGE).alias("message"))


def _segment_series(counts):
    """The dense daily series of every segment, with its keys."""
    a, v, t = SEGMENT_COLUMNS
    return D.dense_grid(counts).select(F.concat_ws("-", a, v, t).alias("series_id"), a, v, t,
                                       F.col("booking_date").alias("ds"), F.col("demand").cast("double").alias("y"))


def _demand_answer(counts, series, fut):
    """The requests' answers from a forecast (series_id, ds, yhat) per segment."""
    a, v, t = SEGMENT_COLUMNS
    fut = fut.select("series_id", "ds", "yhat").join(series.select("series_id", a, v, t).distinct(), "series_id")
    req = _segment_requests(counts)
    req_days = req.select("request_id", a, v, t,
                          F.explode(FC.date_range_days(F.col("start_date"), F.col("end_date")))
                          .alias("ds"))
    r, f = req_days.alias("r"), fut.alias("f")
    joined = r.join(f, (F.col(f"r.{a}") == F.col(f"f.{a}")) & (F.col(f"r.{v}") == F.col(f"f.{v}"))
                    & (F.col("r.ds") == F.col("f.ds"))
                    & (F.col(f"r.{t}").isNull() | (F.col(f"r.{t}") == F.col(f"f.{t}"))))
    rows = (joined.groupBy(F.col("r.request_id").alias("request_id"), F.col("r.ds").alias("ds"))
            .agg(F.sum("f.yhat").alias("yhat"))
            .select("request_id", "ds", FC.clip_round(F.col("yhat")).alias("predicted_bookings")))
    return _answer(rows)


@query
def q_demand_request(spark, sf):
    """G6 + F10 + C15 + C16 + C19 + N5: per-segment demand answers from the
    last week, repeated."""
    counts = _counts(spark, sf)
    series = _segment_series(counts)
    fut = FC.seasonal_naive(series.select("series_id", "ds", "y"), FC.future_days(series.select("series_id", "ds"), 30))
    return _demand_answer(counts, series, fut)


def _demand_model(spark, sf, counts):
    """The saved and loaded model table of all segments' series."""
    path = scratch_path(spark, f"segment-model-{uuid.uuid4().hex}")
    FC.save_models(FC.fit_models(_segment_series(counts).select("series_id", "ds", "y")), path)
    forget_at_exit(spark, path)
    return FC.load_models(spark, path)


def _model_answer(counts, models, req):
    """Answers to requests of any range from the model table: a day of a
    request is the sum over the segments that it covers."""
    a, v, t = SEGMENT_COLUMNS
    segments = counts.select(F.concat_ws("-", a, v, t).alias("series_id"), a, v, F.col(t).alias("_t")).distinct()
    asked = (req.join(segments, [a, v]).filter(F.col(t).isNull() | (F.col(t) == F.col("_t")))
             .select("request_id", "series_id", F.explode(FC.date_range_days(F.col("start_date"), F.col("end_date"))).alias("ds")))
    rows = (FC.predict_days(models, asked).groupBy("request_id", "ds").agg(F.sum("yhat").alias("yhat"))
            .select("request_id", "ds", FC.clip_round(F.col("yhat")).alias("predicted_bookings")))
    return _answer(rows)


@query
def q_demand_request_fitted(spark, sf):
    """The same answers from the additive model, fitted per segment, saved
    as a table (S7) and loaded again (S8)."""
    counts = _counts(spark, sf)
    return _model_answer(counts, _demand_model(spark, sf, counts), _segment_requests(counts))


@query
def q_demand_request_any_range(spark, sf):
    """G10 + G6: requests that begin up to 369 days after the last booking, or
    before it, and last 1 to 31 days."""
    counts = _counts(spark, sf)
    spread = lambda n, salt: F.pmod(F.crc32(F.concat("request_id", F.lit(salt))), F.lit(n)).cast("int")
    req = _segment_requests(counts).withColumn("start_date", F.date_add("start_date", spread(400, "a") - 30))
    req = req.withColumn("end_date", F.date_add("start_date", spread(31, "b")))
    return _model_answer(counts, _demand_model(spark, sf, counts), req)


def _synthetic_bookings(req):
    """One synthetic booking per requested day: starts 10:00, lasts six
    hours, created 24 hours before; fixed ids as in the reference."""
    a, v, t = SEGMENT_COLUMNS
    days = req.select("request_id", a, v, t,
                      F.explode(FC.date_range_days(F.col("start_date"), F.col("end_date"))).alias("ds"))
    start = F.timestamp_add("HOUR", F.lit(10), F.col("ds").cast("timestamp"))
    return days.select(
        "request_id", "ds",
        F.col(v).cast("double").alias("vehicle_model_id"), F.lit(1.0).alias("package_id"),
        F.coalesce(F.col(t), F.lit(1)).cast("double").alias("travel_type_id"),
        F.col(a).cast("double").alias("from_area_id"),
        *[F.lit(0.0).alias(c) for c in ["to_area_id", "from_city_id", "to_city_id"]],
        F.lit(1.0).alias("online_booking"), F.lit(0.0).alias("mobile_site_booking"),
        *[F.lit(None).cast("double").alias(c) for c in ["from_lat", "from_long", "to_lat", "to_long"]],
        start.alias("from_date"), F.timestamp_add("HOUR", F.lit(6), start).alias("to_date"),
        F.timestamp_add("HOUR", F.lit(-24), start).alias("booking_created"))


@query
def q_risk_demand_index(spark, sf):
    """G11 + C18 with the rule score: demand index per requested day."""
    counts = _counts(spark, sf)
    syn = _synthetic_bookings(_segment_requests(counts))
    feats = G.prepare_features(syn, keep=["request_id", "ds"])
    rows = feats.select("request_id", "ds", ML.risk_index(risk_rule()).alias("predicted_bookings"))
    return _answer(rows)


# ---- operational tables: views, listings, change application ---------------------

from fleetcast.operators import asof  # noqa: E402
from fleetcast.operators import tables as TB  # noqa: E402
from fleetcast.sources import snapshots as SN  # noqa: E402

PARTY_EMAIL = "  Customer.000000001@FLEET.test "   # F3 parameter (mixed case, spaces)


def _cust_email(x: F.Column) -> F.Column:
    return F.format_string("customer.%09d@fleet.test", x)


def _cust_username(x: F.Column) -> F.Column:
    return F.format_string("customer%09d", x)


def _events(spark, sf, event_type):
    return read_table(spark, sf, "events").filter(F.col("event_type") == event_type)


def user_batch(spark, sf):
    """User change payloads from signup events (aliases, mixed case, missing
    password, invalid role, matches by e-mail, by username, or both)."""
    ev = _events(spark, sf, "signup")
    u, e = F.col("user_id"), F.col("event_id")
    mode = e % 3
    family = e % 11 == 0                      # new identities that several changes share
    email = (F.when(family, F.concat(F.lit("fam"), (u % 20).cast("string"), F.lit("@fleet.test"))).when(mode == 0, F.concat(F.lit("  "), F.upper(_cust_email(u)), F.lit(" ")))
             .when(mode == 1, F.concat(F.lit("new"), e.cast("string"), F.lit("@fleet.test")))
             .otherwise(_cust_email(u + 2)))
    username = (F.when(family, F.concat(F.lit("fam"), (e % 13).cast("string"))).when(mode == 0, F.concat(F.lit("new"), e.cast("string")))
                .when(mode == 1, _cust_username(u + 1)).otherwise(_cust_username(u)))
    password = F.when(e % 7 != 0, F.concat(F.lit("pw"), e.cast("string")))
    role = F.when(e % 5 == 0, "driver").otherwise("renter")
    payload = F.to_json(F.struct(email.alias("email"), username.alias("username"),
                                 password.alias("password"),
                                 F.concat(F.lit("F"), e.cast("string")).alias("firstName"),
                                 role.alias("role")))
    return ev.select(F.col("event_id").alias("seq"), payload.alias("payload"))


@query
def q_user_view(spark, sf):
    """P2 + C21 + C23: public user records."""
    return presentable(TB.user_view(SN.users(spark, sf)))


@query
def q_vehicle_view(spark, sf):
    """Public vehicle records."""
    return presentable(TB.vehicle_view(SN.vehicles(spark, sf)))


@query
def q_booking_view(spark, sf):
    """Public booking records."""
    return presentable(TB.booking_view(SN.bookings(spark, sf)))


def _comment_summary(view: DataFrame) -> list:
    c = F.col("comments")
    return [F.size(c).alias("n_comments"),
            F.array_join(F.transform(c, lambda x: x["author"]), ",").alias("authors"),
            F.aggregate(F.transform(c, lambda x: F.length(x["message"])), F.lit(0),
                        lambda a, b: a + b).cast("long").alias("message_chars")]


@query
def q_report_view(spark, sf):
    """P5 + N1: log reports with nested fields parsed from JSON text."""
    v = TB.report_view(SN.logreports(spark, sf))
    return presentable(v.select(
        "id", "type", "vehicleId", "rentalId", "amount",
        F.to_json("issues").alias("issues"), F.to_json("customLabels").alias("customLabels"),
        "checkout", *_comment_summary(v)))


@query
def q_bookings_by_party(spark, sf):
    """F3 + F4 + O1: one renter's bookings (e-mail matched case-insensitively
    after trimming), newest first."""
    b = TB.filter_bookings(SN.bookings(spark, sf), renter_email=PARTY_EMAIL)
    return presentable(TB.booking_view(TB.newest(b)))


@query
def q_newest_bookings(spark, sf):
    """O1 + O3 + F5: the 20 newest bookings (top-k is the feature)."""
    return presentable(TB.newest(TB.booking_view(SN.bookings(spark, sf)), 20))


@query
def q_active_users(spark, sf):
    """active users only."""
    return presentable(TB.user_view(SN.users(spark, sf)).filter(F.col("active")))


def booking_batch(spark, sf):
    """Booking creations from purchase events: vehicle by alias, renter e-mail
    with mixed case, amount only when the event value is above 10."""
    ev = _events(spark, sf, "purchase")
    k = F.get_json_object("props", "$.k").cast("long")
    payload = F.to_json(F.struct(
        (k * 25 + F.col("user_id") % 25).alias("vehicleId"),
        F.upper(_cust_email(F.col("user_id"))).alias("renterEmail"),
        (F.col("user_id") * 2 + 1).cast("string").alias("renterId"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("startDate"),
        F.when(F.col("value") > 10, F.col("value")).alias("amount")))
    return ev.select(F.col("event_id").alias("seq"), payload.alias("payload"))


def booking_patch_batch(spark, sf):
    """Booking status patches from click events (some ids do not exist)."""
    ev = _events(spark, sf, "click")
    payload = F.to_json(F.struct(
        F.when(F.col("value") > 25, "cancelled").alias("status"),
        F.when(F.col("value") <= 25, F.col("value")).alias("amount")))
    return ev.select((F.col("event_id") * 2).alias("id"), F.col("event_id").alias("seq"),
                     payload.alias("payload"))


@query
def q_booking_enrichment(spark, sf):
    """J6 + M5 + M11 + P1 + C23: new bookings enriched from their vehicle."""
    new, _ = TB.create_bookings(SN.vehicles(spark, sf), SN.bookings(spark, sf),
                                booking_batch(spark, sf))
    return presentable(new.select("id", "vehicle", "vehicle_name", "renter", "renter_id",
                                  "renter_email", "owner_id", "owner_email", "owner_name",
                                  "start_date", "amount", "status"))


@query
def q_booking_rejects(spark, sf):
    """J6 anti + M12: creations with an unknown vehicle and patches of unknown
    bookings."""
    b = SN.bookings(spark, sf)
    _, rej_new = TB.create_bookings(SN.vehicles(spark, sf), b, booking_batch(spark, sf))
    _, rej_upd = TB.apply_patches(b, booking_patch_batch(spark, sf), "id",
                                  {c: TB.ALIASES["bookings"][c] for c in ("status", "amount")})
    return presentable(rej_new.select("seq", F.lit("create").alias("action"), "reason")
                       .unionByName(rej_upd.select("seq", F.lit("update").alias("action"),
                                                   "reason")))


def _user_outcomes(**frames):
    """One row per change: seq, outcome, the row's public fields, reason."""
    kinds = {"id": "long", "email": "string", "username": "string", "first_name": "string", "role": "string", "reason": "string"}
    rows = [f.select("seq", F.lit(outcome).alias("outcome"),
                     *[F.col(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
            for outcome, f in frames.items()]
    return functools.reduce(DataFrame.unionByName, rows)


@query
def q_user_upsert(spark, sf):
    """M1 + J8: user changes applied in their order, outcome per change."""
    batch = user_batch(spark, sf)
    _, outcomes = TB.upsert_users(SN.users(spark, sf), batch)
    shown = [F.when(F.col("outcome") != "rejected", F.col(c)).alias(c) for c in ("email", "username", "first_name", "role")]
    return presentable(outcomes.join(TB.user_payload(batch).drop("reason"), "seq").select("seq", "outcome", "id", *shown, "reason"))


@query
def q_user_upsert_rows(spark, sf):
    """M1: the rows of the users that the changes touched, as they end up."""
    rows, _ = TB.upsert_users(SN.users(spark, sf), user_batch(spark, sf))
    return presentable(rows.select("id", "seq", "email", "username", "password", "first_name", "role", "active"))


@query
def q_user_insert_if_absent(spark, sf):
    """M2 + M10: register users that do not exist yet, outcome per change."""
    ins, rej = TB.register_users(SN.users(spark, sf), user_batch(spark, sf))
    return presentable(_user_outcomes(inserted=ins, rejected=rej))


def vehicle_patch_batch(spark, sf, explicit_nulls=False):
    """Vehicle patches from view events: price under each of its names, seats,
    location; some prices are no numbers. A null field is absent (M3) or an
    explicit JSON null (M4)."""
    ev = _events(spark, sf, "view")
    k = F.get_json_object("props", "$.k").cast("long")
    e = F.col("event_id")
    price = F.when(F.col("value") > 20, F.when(e % 17 == 0, F.lit("abc")).otherwise(F.col("value").cast("string")))
    names = [] if explicit_nulls else [F.when(e % 3 == 1, price).alias("price"), F.when(e % 3 == 2, price).alias("daily_rate")]
    st = F.struct(
        (price if explicit_nulls else F.when(e % 3 == 0, price)).alias("pricePerDay"), *names,
        F.when(F.col("value") <= 20, (e % 6 + 2)).alias("seats"),
        F.when(F.col("value") > 40, F.concat(F.lit("depot-"), k.cast("string"))).alias("location"))
    opts = {"ignoreNullFields": "false"} if explicit_nulls else {}
    return ev.select((k * 20 + F.col("user_id") % 20).alias("id"),
                     F.col("event_id").alias("seq"), F.to_json(st, opts).alias("payload"))


VEHICLE_PATCH_FIELDS = {c: TB.ALIASES["vehicles"][c] for c in ("price_per_day", "seats", "location")}


@query
def q_patch_coalesce(spark, sf):
    """M3 + M7 (+M12): patches where null keeps the current value."""
    v, _ = TB.apply_patches(SN.vehicles(spark, sf), vehicle_patch_batch(spark, sf), "id",
                            VEHICLE_PATCH_FIELDS)
    return presentable(v.select("id", "price_per_day", "seats", "location"))


@query
def q_patch_present(spark, sf):
    """M4: patches where a present field wins even when null."""
    v, _ = TB.apply_patches(SN.vehicles(spark, sf), vehicle_patch_batch(spark, sf, True), "id",
                            VEHICLE_PATCH_FIELDS, keep_nulls=True)
    return presentable(v.select("id", "price_per_day", "seats", "location"))


@query
def q_delete_rows(spark, sf):
    """M6: delete bookings by id (error events), then the bulk clear of
    those events' renters' bookings from what remains; outcome per affected id."""
    b = SN.bookings(spark, sf)
    dels = _events(spark, sf, "error").select((F.col("event_id") * 2).alias("id"),
                                               F.col("event_id").alias("seq"))
    remaining, removed, rejects = TB.delete_rows(b, dels)
    renters = _events(spark, sf, "error").select((F.col("user_id") * 2 + 1).alias("user_id"))
    _, cleared = TB.clear_user_bookings(remaining, renters)
    return (removed.select("id", F.lit("removed").alias("outcome"))
            .unionByName(rejects.select("id", F.lit("not found").alias("outcome")))
            .unionByName(cleared.select("id", F.lit("cleared").alias("outcome"))))


@query
def q_backfill_column(spark, sf):
    """M9: photo path backfill from a correction table."""
    corr = read_table(spark, sf, "part").filter(F.col("p_size") > 25).select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("/uploads/vehicles/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
        .alias("photo_uri"))
    v = TB.backfill(SN.vehicles(spark, sf), corr, "id", "photo_uri")
    return presentable(v.select("id", "photo_uri"))


@query
def q_apply_change_log(spark, sf):
    """M7: state per id after the whole change log (deletes as barriers,
    latest non-null value per field)."""
    out = TB.fold_change_log(SN.change_log(spark, sf), ["k", "value", "last_event"])
    return presentable(out.withColumn("value", F.col("value").cast("double")))


def vehicle_changes(spark, sf):
    """Vehicle edit requests: actor = event user, target from props."""
    ev = read_table(spark, sf, "events").filter(F.col("event_type").isin("click", "purchase"))
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor_id"),
                     (k * 20 + F.col("user_id") % 20).alias("target_id"),
                     F.lit("update").alias("action"), F.col("value"))


@query
def q_change_permissions(spark, sf):
    """M8 + F9: which vehicle edits the actor may apply, with the reason."""
    out = TB.vehicle_change_permissions(vehicle_changes(spark, sf), SN.users(spark, sf),
                                        SN.vehicles(spark, sf))
    return out.select("seq", "actor_id", "target_id", "accepted", "reason")


@query
def q_change_events(spark, sf):
    """N6 (+T2 batch form): envelopes for the accepted vehicle edits."""
    ok = TB.vehicle_change_permissions(vehicle_changes(spark, sf), SN.users(spark, sf),
                                       SN.vehicles(spark, sf)).filter(F.col("accepted"))
    return TB.event_envelopes(
        ok, F.lit("vehicle_updated"), F.lit("updated"), F.col("target_id"),
        F.struct(F.col("target_id").alias("id"), F.col("actor_id").alias("by"),
                 F.col("seq").alias("seq")))


def _turns(spark, sf):
    return read_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("report_id"), F.col("turn").alias("seq"),
        F.col("role").alias("author"), F.col("text").alias("message"),
        F.lit("").alias("createdAt"))


def _new_comments(spark, sf):
    """The turns that the stored reports don't hold yet."""
    return _turns(spark, sf).filter(F.col("seq") % 2 == 1)


@query
def q_append_comments(spark, sf):
    """N3 + N2: append the arriving conversation turns as report comments."""
    r = TB.append_comments(SN.logreports(spark, sf), _new_comments(spark, sf))
    v = TB.report_view(r)
    return presentable(v.select("id", *_comment_summary(v)))


def _comment_table(spark, sf):
    """The child table after the stored comments and one appended batch."""
    path = scratch_path(spark, f"comments-{uuid.uuid4().hex}")
    forget_at_exit(spark, path)
    reports = SN.logreports(spark, sf)
    CM.write_comments(CM.stored_comments(reports), path)
    CM.write_comments(CM.new_comments(reports, _new_comments(spark, sf), 1)[0], path)
    return CM.read_comments(spark, path)


@query
def q_comment_totals(spark, sf):
    """N2 + N3 with comments as rows: counts and authors after an append that
    rewrites no report."""
    return CM.comment_totals(_comment_table(spark, sf))


@query
def q_newest_comments(spark, sf):
    """N1 with comments as rows: the page of each report's 3 newest comments."""
    return CM.newest_comments(_comment_table(spark, sf), 3).select("report_id", "rank", "author", "message")


@query
def q_set_checkout(spark, sf):
    """Checkout object = the last turn of each conversation."""
    conv = read_table(spark, sf, "conversations")
    co = conv.select(F.col("conv_id").alias("report_id"), F.col("turn").alias("seq"),
                     F.to_json(F.struct(F.col("role").alias("by"), F.col("turn").alias("turn")))
                     .alias("checkout"))
    r = TB.set_checkout(SN.logreports(spark, sf), co)
    return r.select("id", "checkout")


# ---- streams ---------------------------------------------------------------------

from fleetcast.streaming import streams as ST  # noqa: E402


@query
def q_stream_daily_demand(spark, sf):
    """Daily segment demand computed by a stream over booking rows that
    arrive file by file; equals the batch A1."""
    out, ckpt = ST.fresh_dirs(spark, "stream-daily-demand")
    res = ST.run_daily_demand(ST.arriving(_history(spark, sf), f"{out}/feed"), out, ckpt)
    return presentable(res.select("booking_date", *SEGMENT_COLUMNS, "demand"))


def _change_stream(spark, sf, name):
    """The events as changes that arrive in six micro-batches, in no order."""
    out, ckpt = ST.fresh_dirs(spark, name)
    changes = ST.change_rows(ST.arriving(read_table(spark, sf, "events"), f"{out}/feed", 6))
    ST.apply_change_stream(spark, changes, out, ckpt, every=3)
    return out


@query
def q_stream_apply_changes(spark, sf):
    """The change log applied by a stream whose rows arrive out of order;
    the final snapshot equals the batch fold (M7)."""
    snap = ST.latest_snapshot(spark, _change_stream(spark, sf, "stream-changes"))
    return presentable(snap.withColumn("value", F.col("value").cast("double")))


@query
def q_stream_outcomes(spark, sf):
    """T2 + M12: every change of the stream, with the event it became or the
    reason why it was rejected, by all that has arrived."""
    found = ST.outcomes(spark, _change_stream(spark, sf, "stream-outcomes"))
    return found.select("id", "seq", F.coalesce("reason", F.concat(F.col("action"), F.lit("d"))).alias("outcome"))


# ---- models (rows-only checks) -------------------------------------------------------

import hashlib  # noqa: E402

from fleetcast.operators import models as ML  # noqa: E402

CANCEL_MODEL = "random_forest"


def _artifact(spark, sf, name):
    """Artifact folder for one data folder and one application: trained once
    per session, never picked up from an earlier run with other code."""
    key = hashlib.md5(f"{sf}|{spark.sparkContext.applicationId}".encode()).hexdigest()[:12]
    return scratch_path(spark, f"models/{name}-{key}")


def cancellation_model(spark, sf):
    """Train, evaluate and save once per data folder; later callers
    load the saved artifact (kind checked)."""
    path = _artifact(spark, sf, "cancellation")
    if ML.model_exists(spark, path):
        return ML.load_model(spark, path, CANCEL_MODEL)
    with scratch_tables(spark):
        s = materialize(_split_features(spark, sf), "training-input")    # the fit passes over it many times
        model = ML.fit_cancellation(s.filter(F.col("split") == "train"), G.FEATURE_COLUMNS)
        test = materialize(ML.score(model, s.filter(F.col("split") == "test"), ["label"]), "cancellation-scores")
        cm = M.classification_metrics(test).first().asDict()
        auc = M.roc_auc(test).first()["roc_auc"]
        metrics = {"accuracy": cm["accuracy"], "f1": cm["f1"], "roc_auc": auc,
                   "rows": s.count()}
    ML.save_model(spark, model, path, CANCEL_MODEL, G.FEATURE_COLUMNS, metrics)
    return model, G.FEATURE_COLUMNS, metrics


@query
def q_train_cancellation(spark, sf):
    """L2-L6 + A10 + A11 + A15 + A16 + S7 + S11: fit the class-weighted
    forest on the training split, evaluate on the test split; one metrics row."""
    _, feats, metrics = cancellation_model(spark, sf)
    return spark.createDataFrame(
        [(CANCEL_MODEL, len(feats), float(metrics["accuracy"]), float(metrics["f1"]),
          float(metrics["roc_auc"]), int(metrics["rows"]))],
        "model_name string, features int, accuracy double, f1 double, roc_auc double, rows long")


BOOSTED_CANCEL = dict(rounds=200, rate=0.1, leaves=31, waves=5)


def boosted_cancellation(spark, sf):
    """L3: the boosted classifier, saved once per data folder and loaded, and
    the test rows with its score. 200 rounds, as in the reference."""
    path = _artifact(spark, sf, "boosted-cancellation")
    s = materialize(_split_features(spark, sf), "training-input")
    if not ML.model_exists(spark, path):
        BT.save_boosted(spark, BT.fit_boosted_classifier(s.filter("split = 'train'"), G.FEATURE_COLUMNS, **BOOSTED_CANCEL), path)
    model, _ = BT.load_boosted(spark, path)
    return BT.predict(model, s.filter("split = 'test'"), "score")


@query
def q_train_cancellation_boosted(spark, sf):
    """L3 + A10 + A11 + A16 + S7 + S8: the boosted classifier on the test split; one metrics row."""
    test = materialize(boosted_cancellation(spark, sf).select(
        "label", "score", (F.col("score") >= 0.5).cast("int").alias("prediction")), "boosted-scores")
    auc = M.roc_auc(test).first()["roc_auc"]
    return presentable(M.classification_metrics(test).select("accuracy", "f1", F.lit(auc).alias("roc_auc")))


@query
def q_score_bookings(spark, sf):
    """L5 + C17 + S8: label and cancellation score for every booking."""
    model, _, _ = cancellation_model(spark, sf)
    return ML.score(model, _features(spark, sf), ["order_key", "line_number", "label"])


@query
def q_stream_score(spark, sf):
    """T4: arriving bookings scored by the saved model (stateless stream)."""
    model, _, _ = cancellation_model(spark, sf)
    out, ckpt = ST.fresh_dirs(spark, "stream-score")
    keys = ["order_key", "line_number"]
    li = ST.arriving(booking_history(spark, sf).select(*keys, *G.BASE_NUMERIC_COLUMNS, *G.DATE_COLUMNS), f"{out}/feed")
    scored = ML.score(model, G.prepare_features(li, keep=keys), keys)
    scores = ST.score_stream(scored, out, ckpt)
    forget(spark, f"{out}/feed")
    return scores


@query
def q_risk_index_model(spark, sf):
    """G11 + C18 with the trained model: demand index per requested day from
    one synthetic booking per day, scored in one pass."""
    model, _, _ = cancellation_model(spark, sf)
    syn = _synthetic_bookings(_segment_requests(_counts(spark, sf)))
    feats = G.prepare_features(syn, keep=["request_id", "ds"])
    scored = ML.score(model, feats, ["request_id", "ds"])
    return _answer(scored.select("request_id", "ds",
                                 ML.risk_index(F.col("score")).alias("predicted_bookings")))


@query
def q_train_demand_poisson(spark, sf):
    """L7 + L8: Poisson GLM on the demand feature frame, trained on the
    training days, evaluated (clipped at 0) on the test days."""
    feat = materialize(D.build_demand_features(_history(spark, sf)), "demand-features")
    lag_cols = [c for c in D.DEMAND_FEATURE_COLUMNS
                if c.startswith("lag_") or c.startswith("rolling_")]
    filled, flags = ML.fill_lags(feat, lag_cols)
    cols = D.DEMAND_FEATURE_COLUMNS + flags
    model = ML.fit_poisson(filled.filter(F.col("is_train")), cols)
    pred = model.transform(filled.filter(~F.col("is_train")))
    pred = pred.withColumn("yhat", F.greatest(F.col("prediction"), F.lit(0.0)))
    m = M.regression_metrics(pred.withColumn("y", F.col("demand").cast("double")))
    days = feat.agg(F.struct(
        F.countDistinct(F.when(F.col("is_train"), F.col("booking_date"))).alias("training_days"),
        F.countDistinct(F.when(~F.col("is_train"), F.col("booking_date"))).alias("testing_days"),
        F.count(F.lit(1)).alias("grid_rows"))).scalar()
    return presentable(m.select("rows", "mae", "rmse",
                                *[days.getField(c).alias(c)
                                  for c in ("training_days", "testing_days", "grid_rows")]))


BOOSTED = dict(rounds=20, rate=0.1, leaves=31, waves=5, ridge=50.0, least_rows=200)


def boosted_demand(spark, sf):
    """The boosted demand model, saved once per data folder and loaded, and the
    hold-out days with its prediction. The reference takes 500 rounds; a round
    is a few jobs in a row, so the queries take fewer."""
    path = _artifact(spark, sf, "boosted-demand")
    feat = materialize(D.build_demand_features(_history(spark, sf)), "demand-features")
    if not ML.model_exists(spark, path):
        fitted = BT.fit_boosted_poisson(feat.filter("is_train"), D.DEMAND_FEATURE_COLUMNS, **BOOSTED)
        BT.save_boosted(spark, fitted, path)
    model, _ = BT.load_boosted(spark, path)
    return feat, BT.predict(model, feat.filter("not is_train"))


@query
def q_train_demand_boosted(spark, sf):
    """L7 + L8 + S7 + S8: boosted Poisson trees on the demand feature frame,
    evaluated on the days after the split."""
    feat, pred = boosted_demand(spark, sf)
    m = M.regression_metrics(pred.select(F.col("demand").cast("double").alias("y"), F.col("prediction").alias("yhat")))
    days = feat.agg(F.struct(
        F.countDistinct(F.when(F.col("is_train"), F.col("booking_date"))).alias("training_days"),
        F.countDistinct(F.when(~F.col("is_train"), F.col("booking_date"))).alias("testing_days"),
        F.count(F.lit(1)).alias("grid_rows"))).scalar()
    return presentable(m.select("rows", "mae", "rmse", *[days.getField(c).alias(c) for c in ("training_days", "testing_days", "grid_rows")]))


def _area_series(spark, sf):
    """One daily series per pickup area plus the total (many series fit in
    parallel, one per task)."""
    h = _history(spark, sf)
    per_area = D.daily_totals(h, series_id=F.concat(F.lit("area-"),
                                                     F.col("from_area_id").cast("string")))
    return per_area.unionByName(D.daily_totals(h))


@query
def q_forecast_additive(spark, sf):
    """G3 + G4 + G5 + G6: additive forecaster refit on all history, history
    plus 30 future days with 95% bounds, per series."""
    fc = _area_forecast(spark, sf)
    return presentable(fc.select("series_id", "ds", "y", "yhat", "yhat_lower", "yhat_upper"))


@query
def q_forecast_components(spark, sf):
    """Trend, yearly and weekly parts of the additive forecast."""
    fc = _area_forecast(spark, sf)
    return presentable(fc.select("series_id", "ds", "trend", "yearly", "weekly"))


def _area_forecast(spark, sf):
    return FC.additive_forecast(_area_series(spark, sf), periods=30)


@query
def q_forecast_additive_holdout(spark, sf):
    """G3 + G9 + A7-A9: additive forecaster fitted on the first 80% of days,
    hold-out metrics per series and how many actuals fall inside the bounds."""
    s = _area_series(spark, sf)
    cut = D.split_date(s.filter(F.col("series_id") == "total"), "ds")
    fc = FC.additive_forecast(s, periods=0, fit_until=cut)
    test = fc.filter(F.col("ds") > cut).withColumn("yhat", F.greatest(F.col("yhat"), F.lit(0.0)))
    e = F.col("yhat") - F.col("y")
    return presentable(test.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(((F.col("y") >= F.col("yhat_lower")) & (F.col("y") <= F.col("yhat_upper")))
              .cast("int")).alias("inside_bounds")))


@query
def q_text_sentiment(spark, sf):
    """Text classifier trained on the labelled documents, applied to
    every document (whole texts)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    model = ML.fit_text_classifier(docs.join(labels, "doc_id"))
    return ML.classify_text(model, docs, ["doc_id"])


# ---- profile -----------------------------------------------------------------------

from fleetcast.sources import io as IO  # noqa: E402


@query
def q_profile_table(spark, sf):
    """One-pass profile of every numeric line-item column."""
    return presentable(IO.profile(read_table(spark, sf, "lineitem")))


def vehicle_batch(spark, sf):
    """Vehicle creations from signup events: names, aliases for the day
    price, availability given as text or derived from the status."""
    ev = _events(spark, sf, "signup")
    k = F.get_json_object("props", "$.k").cast("long")
    e = F.col("event_id")
    price = F.round(F.col("value") * 3, 2)
    payload = F.to_json(F.struct(
        F.when(k % 3 != 0, F.concat(F.lit("car-"), k.cast("string"))).alias("name"),
        F.concat(F.lit("M"), (k % 7).cast("string")).alias("model"),
        F.when(e % 3 == 0, price).alias("pricePerDay"),
        F.when(e % 3 == 1, price).alias("price"),
        F.when(e % 3 == 2, price).alias("daily_rate"),
        F.when(e % 4 == 0, F.lit("false")).alias("available"),
        F.when(e % 5 == 0, F.lit("rented")).alias("status"),
        F.when(F.col("value") > 25, 2000 + k % 25).alias("year"),
        F.col("user_id").cast("string").alias("ownerId")))
    return ev.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                     payload.alias("payload"))


@query
def q_vehicle_create(spark, sf):
    """M5 + C23 + C24 + C25 + P1: new vehicles with the backend's defaults."""
    out, _ = TB.create_vehicles(SN.vehicles(spark, sf), vehicle_batch(spark, sf))
    return presentable(out.select("seq", "id", "name", "model", "year", "price_per_day",
                                  "available", "owner_id", "approval_status", "status"))


@query
def q_booking_permissions(spark, sf):
    """M8: owners cannot book; only admins clear other renters' bookings."""
    ev = read_table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "error"))
    k = F.get_json_object("props", "$.k").cast("long")
    ch = ev.select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor_id"),
                   F.when(F.col("event_type") == "purchase", "create").otherwise("clear")
                   .alias("action"),
                   F.when(k % 2 == 0, F.col("user_id")).otherwise(k).alias("target_user"))
    out = TB.booking_change_permissions(ch, SN.users(spark, sf))
    return out.select("seq", "actor_id", "action", "target_user", "accepted", "reason")


@query
def q_report_create(spark, sf):
    """M5 for log reports: one new report per conversation turn, with its text
    as notes, aliases, numeric defaults and nested fields as JSON text."""
    turns = read_table(spark, sf, "conversations")
    payload = F.to_json(F.struct(
        F.col("role").alias("type"), F.col("conv_id").alias("vehicleId"), F.col("text").alias("notes"),
        F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") * 10).alias("amount"),
        F.array(F.col("role")).alias("issues")))
    batch = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("seq"), payload.alias("payload"))
    out = TB.create_reports(SN.logreports(spark, sf), batch)
    return presentable(out.select("seq", "id", "type", "vehicle_id", "amount", "issues",
                                  F.length("notes").cast("long").alias("note_chars"),
                                  "photos", "custom_labels", "comments"))


# ---- stored records, owner listing, point lookups ------------------------------------

OWNER_EMAIL = " Supplier.000000001@FLEET.test"     # F4 parameter (mixed case, a blank)


@query
def q_booking_records(spark, sf):
    """The stored booking rows under their public names."""
    return presentable(TB.booking_record(SN.bookings(spark, sf)))


@query
def q_vehicles_by_owner(spark, sf):
    """F4 + O1 for vehicles: one owner's vehicles, newest first."""
    return presentable(TB.vehicle_view(TB.newest(TB.filter_vehicles(SN.vehicles(spark, sf), OWNER_EMAIL))))


@query
def q_lookup_bookings(spark, sf):
    """the bookings that events point at, over the whole id range."""
    bookings = SN.bookings(spark, sf)
    ids = read_table(spark, sf, "events").select(_target(F.col("event_id"), bookings).alias("id"))
    return presentable(TB.booking_view(TB.lookup(bookings, ids)))


# ---- permission rules with admins, patches of users and reports -------------------------

@query
def q_lookup_bookings_by_id(spark, sf):
    """F5 on a table laid out by id: the same answer, from the folders of the ids only."""
    path = scratch_path(spark, f"bookings-by-id-{uuid.uuid4().hex}")
    forget_at_exit(spark, path)
    bookings = SN.bookings(spark, sf)
    LY.write_by_id(bookings, path)
    ids = read_table(spark, sf, "events").select(_target(F.col("event_id"), bookings).alias("id"))
    return presentable(TB.booking_view(LY.lookup_by_id(spark, path, bookings.schema, ids)))


def _target(e: F.Column, table: DataFrame) -> F.Column:
    """A target for each event: ids over the whole range of a table, and a
    quarter as many again that it doesn't have."""
    return F.pmod(e * 7919, F.shiftright((table.agg(F.max("id")).scalar() + 1) * 5, 2))


def _users_with_admins(spark, sf):
    """Stand-in: users with an id that ends in 7 are admins."""
    return SN.users(spark, sf).withColumn("role", F.when(F.col("id") % 10 == 7, "admin").otherwise(F.col("role")))


@query
def q_user_permissions(spark, sf):
    """M8: only admins list, patch and delete users."""
    ev = read_table(spark, sf, "events")
    ch = ev.select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor_id"),
                   (F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "list")
                    .otherwise("patch")).alias("action"), _target(F.col("event_id"), SN.users(spark, sf)).alias("target_id"))
    out = TB.user_change_permissions(ch, _users_with_admins(spark, sf))
    return out.select("seq", "actor_id", "action", "target_id", "accepted", "reason")


def _admin_requests(spark, sf):
    """User requests of all events: the target is another user of the whole id
    range; some ask for a role, some switch the target on or off."""
    e, u = F.col("event_id"), F.col("user_id")
    ev = read_table(spark, sf, "events")
    most = SN.users(spark, sf).agg(F.max("id")).scalar()
    return ev.select(e.alias("seq"), u.alias("actor_id"),
                     F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "list").otherwise("patch").alias("action"),
                     (1 + F.pmod(e * 7919, most)).alias("target_id"),
                     F.when(e % 6 == 0, "admin").when(e % 6 == 1, "renter").alias("role"),
                     F.when(e % 5 == 0, True).when(e % 5 == 1, False).alias("active"))


@query
def q_user_requests_as_of(spark, sf):
    """M8 as of the change: signups switch users (role, active) as they come,
    and every other request is judged by what its actor is by then."""
    users, asked = _users_with_admins(spark, sf), _admin_requests(spark, sf)
    states = asked.join(read_table(spark, sf, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("seq")), "seq").select(
        F.col("actor_id").alias("id"), "seq", "role", "active", F.lit(None).cast("boolean").alias("gone"))
    out = TB.user_changes_as_of(asked.join(states.select("seq"), "seq", "left_anti"), users, states)
    return out.select("seq", "actor_id", "action", "target_id", "actor_role", "actor_active", "accepted", "reason")


@query
def q_user_requests_in_order(spark, sf):
    """M8 one by one: accepted requests change what later ones are judged by."""
    out = TB.user_changes_in_order(_admin_requests(spark, sf), _users_with_admins(spark, sf))
    return out.select("seq", "actor_id", "action", "target_id", "accepted", "reason")


@query
def q_booking_price_as_of(spark, sf):
    """J6 as of the change: new bookings take the vehicle's day price as the
    price changes before them left it."""
    ev = read_table(spark, sf, "events")
    vehicles = SN.vehicles(spark, sf).select("id", "price_per_day")
    most = SN.vehicles(spark, sf).agg(F.max("id")).scalar()
    vehicle = 1 + F.pmod(F.col("user_id") * 31, most)
    prices = ev.filter("event_type = 'view'").select(vehicle.alias("id"), F.col("event_id").alias("seq"), F.col("value").cast("double").alias("price_per_day"))
    asked = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("seq"), vehicle.alias("vehicle"))
    out = asof.as_of(asked, vehicles, prices, "vehicle", "id", "seq", ["price_per_day"])
    return presentable(out.select("seq", "vehicle", F.col("price_per_day").alias("amount")))


@query
def q_vehicle_permissions(spark, sf):
    """M8 + F9: create, update and delete of vehicles by renters, owners and admins."""
    ev = read_table(spark, sf, "events")
    ch = ev.select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor_id"),
                   (F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create")
                    .otherwise("update")).alias("action"), _target(F.col("event_id"), SN.vehicles(spark, sf)).alias("target_id"))
    out = TB.vehicle_change_permissions(ch, _users_with_admins(spark, sf), SN.vehicles(spark, sf))
    return out.select("seq", "actor_id", "action", "target_id", "accepted", "reason")


@query
def q_patch_users(spark, sf):
    """M3 for users: names under both spellings, activity as text, update time."""
    ev = read_table(spark, sf, "events")
    e = F.col("event_id")
    name = F.concat(F.lit("P"), e.cast("string"))
    payload = F.to_json(F.struct(F.when(e % 2 == 0, name).alias("firstName"), F.when(e % 2 == 1, name).alias("first_name"),
                                 F.when(e % 5 == 0, F.lit("false")).alias("active")))
    batch = ev.select((F.col("user_id") * 2 + 1).alias("id"), e.alias("seq"), payload.alias("payload"), F.col("ts"))
    names = TB.ALIASES["users"]
    out, _ = TB.apply_patches(SN.users(spark, sf), batch, "id", {c: names[c] for c in ("first_name", "active")})
    return out.select("id", "first_name", "active", F.substring("updated_at", 1, 10).alias("updated_day"))


@query
def q_patch_reports(spark, sf):
    """M3 for log reports, with the rejects of unknown ids counted per report id."""
    ev = read_table(spark, sf, "events")
    e = F.col("event_id")
    payload = F.to_json(F.struct(F.concat(F.lit("n"), e.cast("string")).alias("notes"),
                                 F.when(F.col("value") > 20, F.col("value")).alias("amount"),
                                 F.when(e % 2 == 0, F.lit("half")).alias("fuelLevel")))
    reports = SN.logreports(spark, sf)
    batch = ev.select(_target(e, read_table(spark, sf, "conversations").select(F.col("conv_id").alias("id"))).alias("id"),
                      e.alias("seq"), payload.alias("payload"))
    names = TB.ALIASES["logreports"]
    out, rej = TB.apply_patches(reports, batch, "id", {c: names[c] for c in ("notes", "amount", "fuel_level")})
    return presentable(out.select("id", "notes", "amount", "fuel_level", F.lit(0).cast("long").alias("rejected"))
                       .unionByName(rej.groupBy("id").agg(F.count("*").alias("rejected")).select(
                           "id", F.lit("").alias("notes"), F.lit(0.0).alias("amount"), F.lit("").alias("fuel_level"), "rejected")))


@query
def q_report_rejects(spark, sf):
    """N3 + N4 + M12: comments of reports that do not exist."""
    c = _turns(spark, sf).withColumn("report_id", F.col("report_id") * 3)
    return TB.unknown_reports(SN.logreports(spark, sf), c)


# ---- sources and sinks --------------------------------------------------------------------

@query
def q_csv_booking_features(spark, sf):
    """S1 + S2 + G1: bookings written as CSV text, read back by name, to features."""
    path = scratch_path(spark, f"bookings-csv-{uuid.uuid4().hex}")
    h = booking_history(spark, sf)
    cols = [*IO.BOOKING_CSV_COLUMNS, *BOOKING_KEYS]
    with shuffles_dropped(spark):
        h.select(*[F.col(c).cast("string").alias(c) for c in cols]).write.option("header", True).option("compression", "gzip").csv(path)
    forget_at_exit(spark, path)
    raw = IO.read_booking_csv(spark, path, columns=cols[::-1], required=["Car_Cancellation"])
    return presentable(G.prepare_features(raw, keep=[
        *[F.col(c).cast("int" if c == "line_number" else "long").alias(c) for c in BOOKING_KEYS],
        F.col(LABEL).cast("int").alias("label")]))


@query
def q_json_change_log(spark, sf):
    """S9 + M7: the change log as JSON lines, of which some are cut off; the
    valid ones are folded, and the broken ones counted (id null)."""
    path = scratch_path(spark, f"changes-json-{uuid.uuid4().hex}")
    log = SN.change_log(spark, sf)
    line = F.to_json(F.struct("entity", "action", "id", "actor_id", "seq", "payload"))
    log.select(F.when(F.col("seq") % 50 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(path)
    forget_at_exit(spark, path)
    ok, bad = IO.read_changes_json(spark, path)
    state = TB.fold_change_log(ok, ["k", "last_event"]).select("id", "k", "last_event", "changes_applied", "last_seq")
    return state.unionByName(bad.agg(F.count("*").alias("changes_applied")).select(
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("k"), F.lit("broken").alias("last_event"),
        "changes_applied", F.lit(None).cast("long").alias("last_seq")))


@query
def q_forecast_csv(spark, sf):
    """The naive outlook of each area, written as CSV by series and read back."""
    path = scratch_path(spark, f"forecast-csv-{uuid.uuid4().hex}")
    dense = FC.dense_series(_area_series(spark, sf))
    fut = FC.seasonal_naive(dense, FC.future_days(dense.select("series_id", "ds"), 30))
    IO.write_forecast_csv(FC.with_bounds(fut, F.lit(1.0)), path)
    forget_at_exit(spark, path)
    back = spark.read.option("header", True).schema(
        "Date string, Forecast double, Lower_Bound double, Upper_Bound double, series_id string").csv(path)
    return presentable(back.select("series_id", "Date", "Forecast"))


# ---- what any fitted model's answer must keep to (each row: its keys and whether it does) ----

def _score_ok():
    p, s = F.col("prediction"), F.col("score")
    return ((s >= 0) & (s <= 1) & ((p == 1) == (s > 0.5)) & (F.col("label_text") == F.when(p == 1, ML.CANCEL_LABELS[1])
                                                             .otherwise(ML.CANCEL_LABELS[0]))).alias("ok")


@query
def q_score_bookings_valid(spark, sf):
    """L5 + C17: a score and the label that follows from it for every booking."""
    return QUERIES["score_bookings"](spark, sf).select("order_key", "line_number", "label", _score_ok())


@query
def q_stream_score_valid(spark, sf):
    """T4: every arriving booking is scored once."""
    return QUERIES["stream_score"](spark, sf).select("order_key", "line_number", _score_ok())


@query
def q_train_cancellation_valid(spark, sf):
    """L2-L6 + S7 + S11: trained on all bookings, metrics in range."""
    m = QUERIES["train_cancellation"](spark, sf)
    return m.select("model_name", "features", "rows", (F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)
                                                      & F.col("roc_auc").between(0, 1)).alias("ok"))


@query
def q_risk_index_valid(spark, sf):
    """G11 + C18: an index from 5 to 20 for every requested day, and its total."""
    total = F.sum("predicted_bookings").over(W.partitionBy("request_id"))
    return QUERIES["risk_index_model"](spark, sf).select(
        "request_id", "date", "number_of_days",
        (F.col("predicted_bookings").between(5, 20) & (F.col("total_predicted_bookings") == total)).alias("ok"))


@query
def q_demand_request_valid(spark, sf):
    """An answer of at least 0 for every requested day, and its total."""
    total = F.sum("predicted_bookings").over(W.partitionBy("request_id"))
    return QUERIES["demand_request_fitted"](spark, sf).select(
        "request_id", "date", "number_of_days",
        ((F.col("predicted_bookings") >= 0) & (F.col("total_predicted_bookings") == total)).alias("ok"))


@query
def q_forecast_valid(spark, sf):
    """G3 + G4 + G8: all history days with their value and 30 days more; the
    forecast is the sum of its parts and lies in the middle of its bounds."""
    fc = _area_forecast(spark, sf)
    parts = F.abs(F.col("yhat") - F.col("trend") - F.col("yearly") - F.col("weekly"))
    middle = F.abs(F.col("yhat_upper") + F.col("yhat_lower") - 2 * F.col("yhat"))
    return presentable(fc.select("series_id", "ds", F.nanvl("y", F.lit(None).cast("double")).alias("y"),
                                 ((parts < 1e-6) & (middle < 1e-6) & (F.col("yhat_upper") >= F.col("yhat"))).alias("ok")))


@query
def q_forecast_holdout_valid(spark, sf):
    """G9 + A7: hold-out rows of each series."""
    h = QUERIES["forecast_additive_holdout"](spark, sf)
    return h.select("series_id", "rows", ((F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae"))
                                          & F.col("inside_bounds").between(0, F.col("rows"))).alias("ok"))


@query
def q_text_sentiment_valid(spark, sf):
    """One label for every document, with the probability of that label."""
    t = QUERIES["text_sentiment"](spark, sf)
    return t.select("doc_id", (F.col("label").isin(*ML.TEXT_LABELS) & F.col("score").between(0.5, 1)).alias("ok"))


@query
def q_forecast_skill(spark, sf):
    """G3 + A7: on the hold-out days the additive forecast is no worse than the
    last week before them, repeated."""
    s = _area_series(spark, sf)
    cut = D.split_date(s.filter(F.col("series_id") == "total"), "ds")
    fitted = FC.additive_forecast(s, periods=0, fit_until=cut).filter(F.col("ds") > cut).select("series_id", "ds", "y", "yhat")
    train = FC.dense_series(s.filter(F.col("ds") <= cut).select("series_id", "ds", "y"))
    last = train.groupBy("series_id").agg(F.max("ds").alias("last_ds"))
    naive = FC.seasonal_naive(train, fitted.select("series_id", "ds").join(last, "series_id")).withColumnRenamed("yhat", "naive")
    both = fitted.join(naive, ["series_id", "ds"])
    error = lambda c: F.avg(F.abs(F.col("y") - F.greatest(F.col(c), F.lit(0.0))))
    return both.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), (error("yhat") <= error("naive")).alias("ok"))


@query
def q_text_skill(spark, sf):
    """X1 + A11: the text classifier ranks the labelled documents (AUC over
    0.9: a random model has 0.5)."""
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    t = QUERIES["text_sentiment"](spark, sf).join(labels, "doc_id")
    score = F.when(F.col("label") == ML.TEXT_LABELS[1], F.col("score")).otherwise(1 - F.col("score"))
    auc = M.roc_auc(t.select(F.col("quality").alias("label"), score.alias("score")), "label", "score")
    return auc.select((F.col("roc_auc") > 0.9).alias("ok"))


@query
def q_poisson_skill(spark, sf):
    """L7 + L8: the hold-out predictions of the Poisson model have the mean of
    the demand, within 15 %."""
    feat = materialize(D.build_demand_features(_history(spark, sf)), "demand-features")
    filled, flags = ML.fill_lags(feat, [c for c in D.DEMAND_FEATURE_COLUMNS if c.startswith("lag_") or c.startswith("rolling_")])
    model = ML.fit_poisson(filled.filter(F.col("is_train")), D.DEMAND_FEATURE_COLUMNS + flags)
    pred = materialize(model.transform(filled.filter(~F.col("is_train"))).select(F.col("demand").cast("double").alias("y"), "prediction"), "poisson-predictions")
    return pred.agg((F.abs(F.avg("prediction") / F.avg("y") - 1) < 0.15).alias("ok"))


@query
def q_boosted_calibration(spark, sf):
    """L7 + L8: the hold-out predictions of the boosted trees have the mean of
    the demand, within 15 %. (The stand-in demand has hardly more to learn than
    its mean: README has the deviances.)"""
    _, pred = boosted_demand(spark, sf)
    return pred.agg((F.abs(F.avg("prediction") / F.avg("demand") - 1) < 0.15).alias("ok"))
