"""Plan shape guards for scale (test_oracle also looks for cartesian products
and nested-loop joins in every query): filters reach the Parquet scan, and the lag
windows need no exchange of their own after the grid join."""

import __spark_entry__ as E
from conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_filter_is_pushed_to_parquet(spark):
    plan = plan_of(E.queries()["patch_coalesce"](spark, SMALL))
    assert "EqualTo(event_type,view)" in plan


def test_one_window_spec_for_all_lags(spark):
    plan = plan_of(E.queries()["demand_rolling"](spark, SMALL))
    # the windows sit directly on the grid join: the segment partitioning of
    # the counts is reused, no exchange between join and window
    lines = [ln.strip() for ln in plan.splitlines()]
    w = max(i for i, ln in enumerate(lines) if ln.startswith("+- Window") or ln.startswith("Window"))
    below = lines[w + 1]
    assert "Exchange" not in below
