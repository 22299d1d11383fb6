"""As-of joins: what was known of a key at the time of a row.

Rows of both sides are sorted together over range partitions of (key, time),
so each row is written once and no pair is formed. A partition fills its own
rows from the versions in it; what a key has to carry over the border of a
partition is at most one row a border. A key with most rows just spans many
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.session import materialize


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], inclusive: bool = False) -> DataFrame:
    """``left`` with, for each of ``values``, the latest non-null one among the
    rows of ``right`` with the same ``key`` and an earlier ``time`` (or an equal
    one, if ``inclusive``). Null where there is none. Of versions with one key
    and time, the largest value is taken. Rows with a null key or time get
    nothing. ``right`` has key, time and the values; ``left`` none of these
    values.
    """
    # key and time are not written twice
    packed = F.struct(F.lit(True).alias("_left"), *[F.col(f"`{c}`") for c in left.columns if c not in (key, time)])
    before = 0 if inclusive else 1                       # at one time, versions come before the rows or after them
    a = left.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1 - before).alias("_side"), packed.alias("_row"),
                    *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    b = (right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(time).alias("_time"))
         .agg(*[F.max(v).alias(f"_{v}") for v in values])
         .select("_key", "_time", F.lit(before).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *[f"_{v}" for v in values]))
    rows = (a.unionByName(b).repartitionByRange("_key", "_time", "_side").withColumn("_part", F.spark_partition_id()))
    rows = materialize(rows, "asof")
    so_far = Window.partitionBy("_part", "_key").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.select("_part", "_key", "_time", "_row", *[F.last(f"_{v}", ignorenulls=True).over(so_far).alias(f"_{v}") for v in values]).filter("_row is not null")
    # keys that span partitions: what each partition of theirs begins with
    at = F.struct("_time", "_side")
    latest = lambda v: F.max_by(f"_{v}", F.when(F.col(f"_{v}").isNotNull(), at))
    ends = rows.groupBy("_key", "_part").agg(*[latest(v).alias(f"_{v}") for v in values])
    spans = ends.groupBy("_key").agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).filter("lo < hi")
    by_part = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ends.join(spans.select("_key"), "_key")
               .select("_key", "_part", *[F.last(f"_{v}", ignorenulls=True).over(by_part).alias(f"c_{v}") for v in values]))
    known = F.col("_key").isNotNull() & F.col("_time").isNotNull()
    pick = lambda v: F.when(known, F.coalesce(f"_{v}", f"c_{v}")).alias(v)
    back = {c: F.col(p).cast(left.schema[c].dataType).alias(c) for c, p in ((key, "_key"), (time, "_time"))}
    return filled.join(carried, ["_key", "_part"], "left").select(
        *[back.get(c, F.col("_row")[c].alias(c)) for c in left.columns], *[pick(v) for v in values])


def as_of(left: DataFrame, snapshot: DataFrame, changes: DataFrame, key: str, id_: str, time: str, values: list[str]) -> DataFrame:
    """``left`` with the columns ``values`` of its row (``key``) in a table, as
    of its ``time``: the snapshot (``id_``, values) with the changes before it
    (``id_``, time, values; null: not changed)."""
    now = asof_join(left, changes.select(F.col(id_).alias(key), time, *values), key, time, values)
    base = snapshot.select(F.col(id_).alias(key), *[F.col(v).alias(f"_{v}") for v in values])
    return now.join(base, key, "left").select(*left.columns, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def permitted_users(changes: DataFrame, users: DataFrame, states: DataFrame | None, reason: Column) -> DataFrame:
    """``changes`` (seq, actor_id, target_id, ...) with ``reason`` as of each
    one. ``states``: changes of users that took effect (id, seq, role, active,
    gone). ``reason`` may use actor_role, actor_active and ``known``; a user
    who is gone is neither."""
    empty = users.select("id", F.lit(0).cast("long").alias("seq"), "role", "active", F.lit(True).alias("gone")).limit(0)
    states = states if states is not None else empty
    base = users.select("id", "role", "active", F.lit(False).alias("gone"))
    fields = ["role", "active", "gone"]
    # a change may itself have columns like a user's
    own = ("seq", "actor_id", "target_id")
    asked = changes.select("seq", "actor_id", "target_id", F.struct(F.lit(True).alias("_change"), *[F.col(f"`{c}`") for c in changes.columns if c not in own]).alias("change"))
    actor = as_of(asked, base, states, "actor_id", "id", "seq", fields)
    alive = F.col("gone").eqNullSafe(F.lit(False))
    actor = actor.select(*asked.columns, F.when(alive, F.col("role")).alias("actor_role"), F.when(alive, F.col("active")).alias("actor_active"))
    target = as_of(actor, base.select("id", "gone"), states.select("id", "seq", "gone"), "target_id", "id", "seq", ["gone"])
    columns = [F.col(c) if c in own else F.col("change")[c].alias(c) for c in changes.columns]
    return (target.select(*columns, "actor_role", "actor_active", F.col("gone").eqNullSafe(F.lit(False)).alias("known"))
            .withColumn("reason", reason).drop("known").withColumn("accepted", F.col("reason").isNull()))


def changes_in_order(changes: DataFrame, users: DataFrame, reason: Column, rounds: int = 1000) -> DataFrame:
    """The changes of users judged one after the other: one that is accepted
    changes the role or the state that the later ones are judged by.
    ``changes``: seq, actor_id, target_id, action ('list', 'patch', 'delete'),
    role, active (null: not changed).

    Every round judges all changes by the ones accepted in the round before;
    after round k all decisions that hang on fewer than k others are final, so
    it ends when a round changes nothing.
    """
    states, judged, before = None, None, None
    for _ in range(rounds):
        judged = materialize(permitted_users(changes, users, states, reason), "judged")      # columns of changes, then the verdict
        took = judged.filter(F.col("accepted") & (F.col("action") != "list")
                             & ((F.col("action") == "delete") | F.col("role").isNotNull() | F.col("active").isNotNull()))
        now = tuple(took.agg(F.count("*"), F.sum(F.xxhash64("seq").cast("decimal(38,0)"))).first())
        if now == before:
            return judged
        before = now
        states = took.select(F.col("target_id").alias("id"), "seq", "role", "active", F.when(F.col("action") == "delete", True).alias("gone"))
    raise RuntimeError(f"decisions still change after {rounds} rounds")
