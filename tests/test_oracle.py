"""Every driver query with an oracle matches DuckDB on the small tables, in
values and types, and its plan has no cartesian product or nested-loop join.
A query is built once for all of these."""

import pytest

import __spark_entry__ as E
from compare import compare, duck
from conftest import SMALL

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(ORACLE[name])
    assert got == dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert compare(df, con, ORACLE[name]) == []


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "demand" in df.columns and "lag_28" in df.columns
