"""Series forecasting operators.

Series are frames of (series_id, ds, y). Everything is keyed by series_id so
that many series are forecast at once, each series' work on the executors.

Two forecasters:

* ``seasonal_naive``: same weekday of the last observed week, by equi joins
  on shifted dates (no window over a whole series). Deterministic, used by
  the driver queries that have a SQL oracle.
* The additive model: piecewise-linear trend + yearly and weekly Fourier terms.
  ``fit_models`` makes a table with one row of coefficients per series (a
  series is days long, so it is fitted in one task). The table is the model: it
  is saved and loaded as such, and ``predict_days`` computes any day of any
  series from it with Spark expressions. ``additive_forecast`` does both.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: two-sided normal quantile of a 0.95 interval.
Z95 = 1.959963984540054
SEASON_DAYS = 7


def dense_series(series: DataFrame) -> DataFrame:
    """Zero-fill each series over its own [first, last] day."""
    bounds = series.groupBy("series_id").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    days = bounds.select("series_id", F.explode(F.sequence("lo", "hi")).alias("ds"))
    return (days.join(series, ["series_id", "ds"], "left")
            .select("series_id", "ds", F.coalesce(F.col("y"), F.lit(0.0)).alias("y")))


def shifted_actuals(dense: DataFrame, days: int = SEASON_DAYS) -> DataFrame:
    """yhat(d) = y(d - days): one-step-ahead seasonal naive, as an equi join."""
    prev = dense.select("series_id", F.date_add("ds", days).alias("ds"), F.col("y").alias("yhat"))
    return dense.join(prev, ["series_id", "ds"])


def residual_std(frame: DataFrame) -> DataFrame:
    """Per-series sample std of (y - yhat): the width of the bounds."""
    return frame.groupBy("series_id").agg(
        F.stddev_samp(F.col("y") - F.col("yhat")).alias("sigma"))


def with_bounds(frame: DataFrame, sigma, z: float = Z95) -> DataFrame:
    """Yhat +- z * sigma (not clipped, as in the reference). ``sigma`` is
    a per-series frame (joined on series_id) or one scalar Column."""
    if isinstance(sigma, Column):
        return (frame.withColumn("yhat_lower", F.col("yhat") - z * sigma)
                .withColumn("yhat_upper", F.col("yhat") + z * sigma))
    return (frame.join(sigma, "series_id", "left")
            .withColumn("yhat_lower", F.col("yhat") - z * F.col("sigma"))
            .withColumn("yhat_upper", F.col("yhat") + z * F.col("sigma"))
            .drop("sigma"))


def future_days(series: DataFrame, periods: int = 30) -> DataFrame:
    """G6 + F8: the ``periods`` days after each series' last observed day."""
    last = series.groupBy("series_id").agg(F.max("ds").alias("last_ds"))
    return last.select("series_id", "last_ds",
                       F.explode(F.sequence(F.date_add("last_ds", 1),
                                            F.date_add("last_ds", periods))).alias("ds"))


def date_range_days(start: Column, end: Column) -> Column:
    """G6 (request form): every day of [start, end]; end < start is an error."""
    return F.when(end >= start, F.sequence(start, end)).otherwise(
        F.raise_error(F.lit("the request ends before it starts")))


def seasonal_naive(dense: DataFrame, future: DataFrame, season: int = SEASON_DAYS) -> DataFrame:
    """Forecast future days by repeating the last observed ``season`` days.

    A future day d maps to the source day d - season * ceil((d - last) /
    season); the value is fetched with an equi join.
    """
    src = F.date_sub("ds", (F.ceil(F.datediff("ds", "last_ds") / season) * season).cast("int"))
    keyed = future.withColumn("src_ds", src)
    vals = dense.select("series_id", F.col("ds").alias("src_ds"), F.col("y").alias("yhat"))
    return keyed.join(vals, ["series_id", "src_ds"], "left").select("series_id", "ds", "yhat")


def clip_round(yhat: Column) -> Column:
    """C15 + C16: round half to even, floor at 0, integer."""
    return F.greatest(F.bround(yhat, 0).cast("int"), F.lit(0))


# --- G3: additive forecaster -------------------------------------------------

FORECAST_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("ds", T.DateType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("yhat", T.DoubleType()),
    T.StructField("yhat_lower", T.DoubleType()),
    T.StructField("yhat_upper", T.DoubleType()),
    T.StructField("trend", T.DoubleType()),
    T.StructField("yearly", T.DoubleType()),
    T.StructField("weekly", T.DoubleType()),
    T.StructField("is_history", T.BooleanType()),
])

# Fixed values of the additive model (after the published description:
# Taylor & Letham, "Forecasting at Scale", 2018).
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_ORDER, YEARLY_PERIOD = 10, 365.25
WEEKLY_ORDER, WEEKLY_PERIOD = 3, 7.0
SEASONALITY_PRIOR = 10.0
CHANGEPOINT_PRIOR = 0.05
SPARSE_ROUNDS, SMALLEST = 25, 1e-4
MODEL_KIND, MODEL_VERSION = "additive", 1

_WAVE = T.ArrayType(T.StructType([T.StructField("sin", T.DoubleType()), T.StructField("cos", T.DoubleType())]))
MODEL_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("series_id", T.StringType()),
    T.StructField("origin", T.DateType()),              # day 0
    T.StructField("last", T.DateType()),                # last day that was fitted
    T.StructField("span", T.DoubleType()),              # days from the one to the other: time 1
    T.StructField("scale", T.DoubleType()),             # unit of all coefficients
    T.StructField("level", T.DoubleType()),
    T.StructField("slope", T.DoubleType()),
    T.StructField("hinges", T.ArrayType(T.StructType([T.StructField("at", T.DoubleType()), T.StructField("bend", T.DoubleType())]))),
    T.StructField("yearly", _WAVE),
    T.StructField("weekly", _WAVE),
    T.StructField("sigma", T.DoubleType()),             # of the residuals, in units of y
    T.StructField("bend_rate", T.DoubleType()),         # hinges per unit of time
    T.StructField("bend_size", T.DoubleType()),         # mean absolute bend
])


def _fourier(t_days: np.ndarray, period: float, order: int) -> np.ndarray:
    cols = []
    for k in range(1, order + 1):
        x = 2.0 * math.pi * k * t_days / period
        cols += [np.sin(x), np.cos(x)]
    return np.column_stack(cols) if cols else np.zeros((len(t_days), 0))


def _sparse_solve(X: np.ndarray, y: np.ndarray, bends: slice, ridge: np.ndarray) -> np.ndarray:
    """Maximum a posteriori with a Laplace prior on the ``bends`` and normal
    ones (``ridge``: inverse variances) elsewhere, by reweighted ridge solves: a
    bend's penalty is what makes the quadratic touch the prior at its last size."""
    gram, target = X.T @ X, X.T @ y
    noise, size = max(float(y.var()), 1e-8), np.full(bends.stop - bends.start, CHANGEPOINT_PRIOR)
    beta = np.zeros(X.shape[1])
    for _ in range(SPARSE_ROUNDS):
        penalty = ridge.copy()
        penalty[bends] = 1.0 / (CHANGEPOINT_PRIOR * np.maximum(size, SMALLEST))
        before, beta = beta, np.linalg.solve(gram + noise * np.diag(penalty) + 1e-9 * np.eye(len(gram)), target)
        noise, size = max(float(np.mean((y - X @ beta) ** 2)), 1e-8), np.abs(beta[bends])
        if np.abs(beta - before).max() < 1e-7:
            break
    return beta


def _fit(pdf: pd.DataFrame, yearly: bool, weekly: bool) -> pd.DataFrame:
    pdf = pdf[pdf["fit"]].sort_values("ds")
    if len(pdf) < 2:
        return pd.DataFrame(columns=MODEL_SCHEMA.names)
    ds, y = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]"), pdf["y"].to_numpy(dtype=float)
    days = (ds - ds[0]).astype(float)
    span = max(days[-1], 1.0)
    t = days / span
    # hinges evenly over the first part of the fitted history
    knots = np.linspace(0, CHANGEPOINT_RANGE, min(N_CHANGEPOINTS, len(y) - 1) + 1)[1:]
    waves = [_fourier(days, YEARLY_PERIOD, YEARLY_ORDER if yearly else 0), _fourier(days, WEEKLY_PERIOD, WEEKLY_ORDER if weekly else 0)]
    X = np.hstack([np.ones((len(t), 1)), t[:, None], np.maximum(t[:, None] - knots, 0.0), *waves])
    scale = max(np.abs(y).max(), 1.0)
    k = 2 + len(knots)
    ridge = np.concatenate([np.zeros(k), np.full(X.shape[1] - k, 1.0 / SEASONALITY_PRIOR ** 2)])
    beta = _sparse_solve(X, y / scale, slice(2, k), ridge)
    n = k + waves[0].shape[1]
    pairs = lambda b: [{"sin": float(p), "cos": float(q)} for p, q in zip(b[::2], b[1::2])]
    return pd.DataFrame([{
        "kind": MODEL_KIND, "version": MODEL_VERSION, "series_id": pdf["series_id"].iloc[0], "origin": ds[0].item(), "last": ds[-1].item(),
        "span": span, "scale": scale, "level": beta[0], "slope": beta[1],
        "hinges": [{"at": float(c), "bend": float(b)} for c, b in zip(knots, beta[2:k])],
        "yearly": pairs(beta[k:n]), "weekly": pairs(beta[n:]), "sigma": float(np.std(y - X @ beta * scale, ddof=1)),
        "bend_rate": len(knots) / CHANGEPOINT_RANGE, "bend_size": float(np.abs(beta[2:k]).mean())}], columns=MODEL_SCHEMA.names)


def fit_models(series: DataFrame, fit_until: Column | None = None, yearly: bool = True, weekly: bool = True) -> DataFrame:
    """G3 + G5: the model table (MODEL_SCHEMA) from (series_id, ds, y), fitted on
    the rows with ds <= fit_until (all when None). Series with fewer than two
    such rows have no row.

    One pandas call per series: Spark shuffles rows by series_id and fits the
    series in parallel. A series is one row per day, so its size is bounded by
    the calendar, not by the booking volume.
    """
    fit = F.lit(True) if fit_until is None else F.coalesce(F.col("ds") <= fit_until, F.lit(False))
    rows = series.select("series_id", "ds", F.col("y").cast("double").alias("y"), fit.alias("fit")).filter("y is not null")
    return rows.groupBy("series_id").applyInPandas(lambda pdf: _fit(pdf, yearly, weekly), MODEL_SCHEMA)


def save_models(models: DataFrame, path: str) -> None:
    """The table is the saved model."""
    models.write.mode("overwrite").parquet(path)


def load_models(spark, path: str) -> DataFrame:
    """The saved table; an error unless all its rows are of this model."""
    models = spark.read.schema(MODEL_SCHEMA).parquet(path)
    odd = models.filter(~F.col("kind").eqNullSafe(F.lit(MODEL_KIND)) | ~F.col("version").eqNullSafe(F.lit(MODEL_VERSION))).limit(1).count()
    if odd:
        raise ValueError(f"model_kind: {path} has rows that are not {MODEL_KIND} models of version {MODEL_VERSION}")
    return models


def _total(items: Column, term) -> Column:
    return F.aggregate(F.transform(items, term), F.lit(0.0), lambda x, y: x + y)


def predict_days(models: DataFrame, days: DataFrame, interval_z: float = Z95) -> DataFrame:
    """``days`` (series_id, ds, ...) with yhat, its bounds and the trend, yearly
    and weekly parts, computed from the model table for any day.

    After the last fitted day the trend may bend again as often and as much as
    it did before: bends of mean absolute size b come at a rate r, so that at
    time t the trend has a variance of 2 b^2 r (t - 1)^3 / 3 around its straight
    course, which is added to the residuals'. Days of series without a model
    are left out.
    """
    day = F.datediff("ds", "origin").cast("double")
    t = day / F.col("span")
    turn = lambda period: lambda c, k: (c["sin"] * F.sin((k + 1) * day * (2 * math.pi / period))
                                        + c["cos"] * F.cos((k + 1) * day * (2 * math.pi / period)))
    trend = F.col("level") + F.col("slope") * t + _total(F.col("hinges"), lambda h: h["bend"] * F.greatest(t - h["at"], F.lit(0.0)))
    ahead = F.greatest(t - 1.0, F.lit(0.0))
    drift = F.col("scale") * F.col("bend_size") * F.sqrt(F.col("bend_rate") * 2 / 3 * ahead * ahead * ahead)
    parts = days.join(models.drop("kind", "version", "last"), "series_id").select(
        *days.columns, (F.col("scale") * trend).alias("trend"),
        (F.col("scale") * _total(F.col("yearly"), turn(YEARLY_PERIOD))).alias("yearly"),
        (F.col("scale") * _total(F.col("weekly"), turn(WEEKLY_PERIOD))).alias("weekly"),
        (interval_z * F.sqrt(F.col("sigma") ** 2 + drift * drift)).alias("_half"))
    yhat = F.col("trend") + F.col("yearly") + F.col("weekly")
    return parts.select(*days.columns, yhat.alias("yhat"), (yhat - F.col("_half")).alias("yhat_lower"),
                        (yhat + F.col("_half")).alias("yhat_upper"), "trend", "yearly", "weekly")


def additive_forecast(series: DataFrame, periods: int = 30, fit_until: Column | None = None,
                      interval_z: float = Z95, yearly: bool = True,
                      weekly: bool = True) -> DataFrame:
    """G3 + G4 + G5 + G8: fit on the rows with ds <= fit_until (all rows when
    None: the refit of G5), predict every history day plus ``periods`` future
    days, with bounds and the trend / yearly / weekly components."""
    models = fit_models(series, fit_until, yearly, weekly)
    days = series.select("series_id", "ds", F.col("y").cast("double").alias("y"), F.lit(True).alias("is_history"))
    if periods:
        days = days.unionByName(future_days(series, periods).select(
            "series_id", "ds", F.lit(None).cast("double").alias("y"), F.lit(False).alias("is_history")))
    return predict_days(models, days, interval_z).select(*FORECAST_SCHEMA.names)
