"""As-of joins and changes judged in order, against one-by-one versions."""

import random

import pytest
from pyspark.sql import functions as F

from fleetcast.operators import tables as TB
from fleetcast.operators.asof import asof_join


def brute(left, right, inclusive):
    out = []
    for k, t, x in left:
        found = []
        for i in (2, 3):
            seen = [(r[1], r[i]) for r in right if k is not None and t is not None and r[0] == k and r[i] is not None
                    and (r[1] < t or inclusive and r[1] == t)]
            found.append(max(seen)[1] if seen else None)
        out.append((k, t, x, *found))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, keys, inclusive", [(1, 5, False), (2, 1, True), (3, 200, False), (4, 2, False)])
def test_asof_join_equals_brute_force(spark, seed, keys, inclusive):
    rng = random.Random(seed)
    some = lambda p, v: v if rng.random() < p else None
    left = [(some(0.95, rng.randint(1, keys)), some(0.97, rng.randint(1, 300)), i) for i in range(400)]
    right = [(some(0.95, rng.randint(1, keys)), some(0.97, rng.randint(1, 300)), some(0.6, rng.randint(1, 9)), some(0.3, f"s{rng.randint(1, 9)}")) for _ in range(200)]
    a = spark.createDataFrame(left, "k long, t long, x long").repartition(7)
    b = spark.createDataFrame(right, "k long, t long, v long, w string").repartition(5)
    found = asof_join(a, b, "k", "t", ["v", "w"], inclusive)
    usable = [r for r in right if r[0] is not None and r[1] is not None]
    assert found.columns == ["k", "t", "x", "v", "w"] and sorted(map(tuple, found.collect()), key=str) == brute(left, usable, inclusive)


def test_asof_join_of_empty_sides(spark):
    a, b = spark.createDataFrame([(1, 2)], "k long, t long"), spark.createDataFrame([(1, 1, 5)], "k long, t long, v long")
    assert asof_join(a, b.limit(0), "k", "t", ["v"]).collect()[0].v is None
    assert asof_join(a.limit(0), b, "k", "t", ["v"]).count() == 0


def test_one_key_spans_partitions_and_no_pairs_are_made(spark):
    a = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("t"))
    b = spark.range(20_000).filter("id % 100 = 0").select(F.lit(1).alias("k"), (F.col("id") * 2 + 1).alias("t"), F.col("id").alias("v"))
    r = asof_join(a, b, "k", "t", ["v"])
    assert r.filter("v <> floor((t - 2) / 200) * 100 or (v is null and t > 1)").count() == 0 and r.count() == 20_000


def one_by_one(users, changes):
    state, out = {u: list(v) for u, v in users.items()}, {}
    for seq, actor, action, target, role, active in sorted(changes):
        a = state.get(actor)
        reason = (TB.NO_ACTIVE_USER if a is None or not a[1] else TB.ADMINS_ONLY if a[0] != "admin"
                  else TB.UNKNOWN_ID if action != "list" and target not in state else None)
        out[seq] = reason
        if reason is None and action == "delete":
            del state[target]
        elif reason is None and action == "patch":
            state[target] = [role or state[target][0], state[target][1] if active is None else active]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_in_order_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    users = {i: (rng.choice(["admin", "admin", "renter"]), rng.random() < 0.9) for i in range(1, 13)}
    changes = [(s, rng.randint(1, 14), rng.choice(["list", "patch", "patch", "patch", "delete"]), rng.randint(1, 14),
                rng.choice([None, None, "admin", "renter"]), rng.choice([None, None, True, False])) for s in range(1, 61)]
    u = spark.createDataFrame([(i, *v) for i, v in users.items()], "id long, role string, active boolean")
    c = spark.createDataFrame(changes, "seq long, actor_id long, action string, target_id long, role string, active boolean").repartition(4)
    got = {r.seq: r.reason for r in TB.user_changes_in_order(c, u).collect()}
    assert got == one_by_one(users, changes)
    assert len(set(got.values())) == 4


def test_a_deactivated_actor_is_refused_from_then_on(spark):
    u = spark.createDataFrame([(1, "admin", True), (2, "admin", True), (3, "renter", True)], "id long, role string, active boolean")
    c = spark.createDataFrame([(1, 2, "patch", 3, None, False), (2, 1, "patch", 2, None, False), (3, 2, "patch", 3, None, True),
                               (4, 1, "delete", 3, None, None), (5, 1, "patch", 3, None, True)],
                              "seq long, actor_id long, action string, target_id long, role string, active boolean")
    assert {r.seq: r.reason for r in TB.user_changes_in_order(c, u).collect()} == {1: None, 2: None, 3: TB.NO_ACTIVE_USER, 4: None, 5: TB.UNKNOWN_ID}


def test_key_and_time_are_written_once(spark, monkeypatch):
    """Rows carry their other columns only; the key keeps its type and its nulls."""
    from fleetcast.operators import asof
    written = []
    monkeypatch.setattr(asof, "materialize", lambda df, name: written.append(df.schema) or df.localCheckpoint())
    left = spark.createDataFrame([(1, 5, "a"), (1, 2, "b"), (None, 5, "c"), (2, None, "d")], "k int, t long, x string")
    right = spark.createDataFrame([(1, 3, "v")], "k long, t long, v string")
    out = asof.asof_join(left, right, "k", "t", ["v"])
    assert not {"k", "t"} & set(written[0]["_row"].dataType.names)
    assert out.columns == ["k", "t", "x", "v"] and out.schema["k"].dataType == left.schema["k"].dataType
    assert {tuple(r) for r in out.collect()} == {(1, 5, "a", "v"), (1, 2, "b", None), (None, 5, "c", None), (2, None, "d", None)}
