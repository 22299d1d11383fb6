"""Demand series, dense grid, lags and target means (SURVEY A1-A6, J1-J5,
W1-W5, G2, F7).

Shape of the work at scale: the booking fact table is read once and collapsed
by a partial+final hash aggregate to (date, segment) counts. Everything after
that (grid, windows, target means) works on days x segments rows, a size set
by the calendar span and the number of segments, not by the number of
bookings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.functions.calendar import add_holiday_flags, calendar_columns, cyclic_columns
from fleetcast.session import materialize
from fleetcast.sources.tables import SEGMENT_COLUMNS

# Fixed values of the demand model.
LAG_FEATURES = [1, 7, 14, 28]
ROLLING_WINDOWS = [7, 14, 28]
STATIC_FEATURES = [
    "segment_mean_demand",
    "area_mean_demand",
    "vehicle_model_mean_demand",
    "travel_type_mean_demand",
]
TRAIN_FRACTION = 0.8
MIN_DATES = 10

DEMAND_FEATURE_COLUMNS = [
    "from_area_id", "vehicle_model_id", "travel_type_id",
    "dayofweek", "month", "dayofmonth", "weekofyear", "dayofyear",
    "is_weekend", "is_month_start", "is_month_end", "is_quarter_start",
    "is_quarter_end", "is_payday", "is_holiday", "is_holiday_window",
    "dayofyear_sin", "dayofyear_cos", "month_sin", "month_cos",
    *STATIC_FEATURES,
    *[f"lag_{k}" for k in LAG_FEATURES],
    *[f"rolling_mean_{k}" for k in ROLLING_WINDOWS],
    "rolling_std_7",
]


def daily_segment_counts(history: DataFrame, date_col: str = "booking_date") -> DataFrame:
    """A1: bookings per day and segment (null keys form their own group)."""
    return (history.groupBy(date_col, *SEGMENT_COLUMNS)
            .agg(F.count(F.lit(1)).cast("int").alias("demand")))


def daily_totals(history: DataFrame, date_col: str = "booking_date",
                 series_id: Column | None = None) -> DataFrame:
    """A2: one series (series_id, ds, y) of bookings per day."""
    sid = series_id if series_id is not None else F.lit("total")
    return (history.groupBy(sid.alias("series_id"), F.col(date_col).alias("ds"))
            .agg(F.count(F.lit(1)).cast("double").alias("y")))


def date_bounds(frame: DataFrame, date_col: str = "booking_date") -> Column:
    """A3: [min, max] date as one scalar-subquery struct Column (lo, hi)."""
    return frame.agg(F.struct(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))).scalar()


def dense_grid(counts: DataFrame, date_col: str = "booking_date") -> DataFrame:
    """J1 + J2 + A5: every date of the global range x every seen segment,
    zero-filled.

    The date axis is generated with ``sequence`` from the scalar bounds, so
    there is no nested-loop join; the left join to the counts is an equi join
    on (date, segment).
    """
    b = date_bounds(counts, date_col)
    # One hash partitioning by segment serves the distinct, the grid join and
    # the per-segment windows that follow: no further exchange until output.
    by_seg = counts.repartition(*SEGMENT_COLUMNS)
    segments = by_seg.select(*SEGMENT_COLUMNS).distinct()
    grid = segments.select(*SEGMENT_COLUMNS,
                           F.explode(F.sequence(b.getField("lo"), b.getField("hi"))).alias(date_col))
    return (grid.join(by_seg, [date_col, *SEGMENT_COLUMNS], "left")
            .select(date_col, *SEGMENT_COLUMNS,
                    F.coalesce(F.col("demand"), F.lit(0)).cast("int").alias("demand")))


def segment_window(date_col: str = "booking_date"):
    return Window.partitionBy(*SEGMENT_COLUMNS).orderBy(date_col)


def lag_columns(target: str = "demand", date_col: str = "booking_date") -> list[Column]:
    """W1-W3 in one window spec: one exchange and one sort for all of them.

    Rolling statistics cover the previous k rows (the current day excluded);
    on the dense grid a row is a day, so rows == days.
    """
    w = segment_window(date_col)
    cols = [F.lag(target, k).over(w).alias(f"lag_{k}") for k in LAG_FEATURES]
    cols += [F.avg(target).over(w.rowsBetween(-k, -1)).alias(f"rolling_mean_{k}")
             for k in ROLLING_WINDOWS]
    cols.append(F.stddev_samp(target).over(w.rowsBetween(-7, -1)).alias("rolling_std_7"))
    return cols


def add_lag_features(grid: DataFrame, target: str = "demand",
                     date_col: str = "booking_date") -> DataFrame:
    return grid.select("*", *lag_columns(target, date_col))


def target_means(frame: DataFrame, target: str = "demand") -> DataFrame:
    """A4: global, per-area, per-model, per-travel-type and per-segment means
    in one GROUPING SETS pass. ``level`` names the grouping set."""
    a, v, t = SEGMENT_COLUMNS
    gs = frame.groupingSets([[], [a], [v], [t], [a, v, t]], a, v, t)
    out = gs.agg(F.avg(target).alias("mean_demand"), F.grouping_id().alias("gid"))
    level = (F.when(F.col("gid") == 7, "global").when(F.col("gid") == 3, "area")
             .when(F.col("gid") == 5, "vehicle_model").when(F.col("gid") == 6, "travel_type")
             .otherwise("segment"))
    return out.select(level.alias("level"), a, v, t, "mean_demand")


def add_static_features(frame: DataFrame, means: DataFrame) -> DataFrame:
    """J3 + J4: look up the four means, defaulting to the global mean (0.0 when
    the training frame was empty).

    The lookup tables hold one row per distinct key; they are left to AQE,
    which broadcasts them after measuring their real size.
    """
    a, v, t = SEGMENT_COLUMNS
    glob = F.coalesce(
        means.filter(F.col("level") == "global").agg(F.max("mean_demand")).scalar(),
        F.lit(0.0))
    seg = means.filter(F.col("level") == "segment").select(
        a, v, t, F.col("mean_demand").alias("segment_mean_demand"))
    area = means.filter(F.col("level") == "area").select(
        a, F.col("mean_demand").alias("area_mean_demand"))
    model = means.filter(F.col("level") == "vehicle_model").select(
        v, F.col("mean_demand").alias("vehicle_model_mean_demand"))
    travel = means.filter(F.col("level") == "travel_type").select(
        t, F.col("mean_demand").alias("travel_type_mean_demand"))
    out = (frame.join(seg, [a, v, t], "left").join(area, [a], "left")
           .join(model, [v], "left").join(travel, [t], "left"))
    for c in STATIC_FEATURES:
        out = out.withColumn(c, F.coalesce(F.col(c), glob))
    return out


def split_date(frame: DataFrame, date_col: str = "booking_date",
               fraction: float = TRAIN_FRACTION, min_dates: int = MIN_DATES,
               at_least_one: bool = True) -> Column:
    """The cut date of a chronological split over distinct dates.

    The k-th smallest distinct date, k = max(1, int(fraction * n)). Distinct
    dates are bounded by the calendar span (tens of thousands at most), so the
    sorted date list is a small one-row aggregate, returned as a scalar
    subquery. Fewer than ``min_dates`` dates -> the query fails, as in the
    reference.
    """
    dates = frame.select(date_col).distinct()
    n = F.count(F.lit(1))
    k = F.floor(n * F.lit(fraction)).cast("int")
    if at_least_one:
        k = F.greatest(F.lit(1), k)
    cut = dates.agg(
        F.when(n >= min_dates, F.try_element_at(F.array_sort(F.collect_list(date_col)), k))
        .otherwise(F.raise_error(F.lit(f"too_few_dates: a split by date takes {min_dates} booking dates")))
    ).scalar()
    return cut


def segment_counts_table(history: DataFrame) -> DataFrame:
    """A1, computed once and written: the single pass over the bookings.

    Grid, split date, holiday range and target means all read this small
    table (days x segments rows) instead of re-running the fact-table join.
    """
    return materialize(daily_segment_counts(history), "segment-counts")


def build_demand_features(history: DataFrame) -> DataFrame:
    """The 32-column demand feature frame plus booking_date, demand and
    the train/test flag. Target means come from the training days only."""
    counts = segment_counts_table(history)
    # the grid feeds the split date, the holiday range, the windows and the
    # target means: written once (days x segments rows)
    grid = materialize(dense_grid(counts), "demand-grid")
    cut = split_date(grid)
    feat = add_holiday_flags(grid.select("*", *calendar_columns(), *cyclic_columns()))
    feat = add_lag_features(feat)
    feat = feat.withColumn("is_train", F.col("booking_date") <= cut)
    means = target_means(feat.filter(F.col("is_train")))
    feat = add_static_features(feat, means)
    return feat.select("booking_date", *DEMAND_FEATURE_COLUMNS, "demand", "is_train")
