"""Calendar and holiday features.

Everything is a Column expression over a date column, except the holiday
calendar, which is a small date dimension generated by Spark from the data's
own date range: at most 11 holidays per year, so it is bounded by the span of
the calendar, never by the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_columns(date_col="booking_date") -> list[Column]:
    """Integer calendar parts and flags (Monday = 0)."""
    d = _c(date_col)
    quarter_start = F.trunc(d, "quarter")
    return [
        F.weekday(d).alias("dayofweek"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("dayofmonth"),
        F.weekofyear(d).alias("weekofyear"),
        F.dayofyear(d).alias("dayofyear"),
        (F.weekday(d) >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"),
        (d == F.last_day(d)).cast("int").alias("is_month_end"),
        (d == quarter_start).cast("int").alias("is_quarter_start"),
        (d == F.last_day(F.add_months(quarter_start, 2))).cast("int").alias("is_quarter_end"),
        F.dayofmonth(d).isin(1, 15).cast("int").alias("is_payday"),
    ]


def cyclic_columns(date_col="booking_date") -> list[Column]:
    """sine/cosine of day of year (period 365.25) and month (period 12)."""
    d = _c(date_col)
    two_pi = 2.0 * math.pi
    doy = F.dayofyear(d) * two_pi / 365.25
    mon = F.month(d) * two_pi / 12.0
    return [
        F.sin(doy).alias("dayofyear_sin"),
        F.cos(doy).alias("dayofyear_cos"),
        F.sin(mon).alias("month_sin"),
        F.cos(mon).alias("month_cos"),
    ]


# --- C14: US federal holidays -------------------------------------------------
# Fixed values (the rules of the US federal holiday calendar):
#   New Year's Day        January 1          nearest weekday
#   Birthday of M. L. King third Monday of January, from 1986
#   Washington's Birthday third Monday of February
#   Memorial Day          last Monday of May
#   Juneteenth            June 19, from 2021 nearest weekday
#   Independence Day      July 4             nearest weekday
#   Labor Day             first Monday of September
#   Columbus Day          second Monday of October
#   Veterans Day          November 11        nearest weekday
#   Thanksgiving          fourth Thursday of November
#   Christmas Day         December 25        nearest weekday
# "Nearest weekday": Saturday -> Friday before, Sunday -> Monday after.

def _nearest_weekday(d: Column) -> Column:
    wd = F.weekday(d)
    return (F.when(wd == 5, F.date_add(d, -1))
            .when(wd == 6, F.date_add(d, 1))
            .otherwise(d))


def _nth_weekday(y: Column, month: int, day_name: str, n: int) -> Column:
    first = F.make_date(y, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_add(first, -1), day_name), 7 * (n - 1))


def _last_monday(y: Column, month: int, last_day: int) -> Column:
    return F.date_add(F.next_day(F.make_date(y, F.lit(month), F.lit(last_day)), "MON"), -7)


def holidays_of_year(y: Column) -> Column:
    """Array of the observed holiday dates of year ``y`` (nulls where a rule
    does not apply yet)."""
    def fixed(m, d):
        return _nearest_weekday(F.make_date(y, F.lit(m), F.lit(d)))
    return F.array(
        fixed(1, 1),
        F.when(y >= 1986, _nth_weekday(y, 1, "MON", 3)),
        _nth_weekday(y, 2, "MON", 3),
        _last_monday(y, 5, 31),
        F.when(y >= 2021, fixed(6, 19)),
        fixed(7, 4),
        _nth_weekday(y, 9, "MON", 1),
        _nth_weekday(y, 10, "MON", 2),
        fixed(11, 11),
        _nth_weekday(y, 11, "THU", 4),
        fixed(12, 25),
    )


def holiday_calendar(lo: Column, hi: Column, spark) -> DataFrame:
    """Observed holidays inside [lo, hi] (two scalar date Columns).

    Years are generated from lo-1 to hi+1 so that a New Year's Day observed on
    December 31 of the year before is kept.
    """
    years = spark.range(1).select(
        F.explode(F.sequence(F.year(lo) - 1, F.year(hi) + 1)).alias("y"))
    return (years
            .select(F.explode(holidays_of_year(F.col("y"))).alias("holiday"))
            .filter(F.col("holiday").isNotNull()
                    & (F.col("holiday") >= lo) & (F.col("holiday") <= hi))
            .distinct())


def holiday_window(holidays: DataFrame) -> DataFrame:
    """The set of holidays shifted by -1, 0 and +1 day."""
    return (holidays
            .select("holiday", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("offset"))
            .select(F.date_add("holiday", F.col("offset")).alias("window_day"))
            .distinct())


def add_holiday_flags(frame: DataFrame, date_col: str = "booking_date") -> DataFrame:
    """C14 + J5: is_holiday and is_holiday_window for every row of ``frame``.

    The range is the frame's own [min, max] date (scalar subqueries); the
    holiday tables are bounded by 33 rows per year, so broadcasting them is
    safe at any data size.
    """
    spark = frame.sparkSession
    bounds = frame.agg(F.struct(F.min(date_col).alias("lo"),
                                F.max(date_col).alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    hol = holiday_calendar(lo, hi, spark)
    win = holiday_window(hol)
    return (frame
            .join(F.broadcast(hol), F.col(date_col) == F.col("holiday"), "left")
            .join(F.broadcast(win), F.col(date_col) == F.col("window_day"), "left")
            .withColumn("is_holiday", F.col("holiday").isNotNull().cast("int"))
            .withColumn("is_holiday_window", F.col("window_day").isNotNull().cast("int"))
            .drop("holiday", "window_day"))
