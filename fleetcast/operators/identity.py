"""Changes of user identities, applied in their own order.

A change finds its user by e-mail or by user name, and may then take both
away from where they were. What a change meets therefore depends on the ones
before it, but only on those it is tied to: by a shared e-mail or name, or by
a stored user who holds one of each. ``groups`` finds these ties as connected
components; within a group the changes are replayed in seq order.

Groups are dealt to tasks together, about ``at_once`` changes each. A group
with more is replayed in runs of that many, one run after the other, with its
users' identities written in between: order within a group is what the rule
asks for, so it is the one thing that is not done side by side, but no task
ever holds more than a run of it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.session import materialize

AT_ONCE = 100_000


def _node(kind: str, value: str) -> Column:
    """A number for an e-mail or a name. Two that collide only share a group."""
    return F.xxhash64(F.lit(kind), F.col(value))


def groups(edges: DataFrame) -> DataFrame:
    """``node`` and ``group`` of every node of ``edges`` (a, b).

    Contraction: in each round every node is merged into the best of itself and
    its neighbours, under an order drawn anew by hash, and edges inside a merged
    node go. That takes a number of rounds in the order of the logarithm of
    the longest path, since a random order has no long descents.
    """
    labels = materialize(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
                         .withColumn("group", F.col("node")), "group-labels")
    edges = materialize(edges.filter("a <> b").distinct(), "group-edges")
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("by"), F.col(c).alias("to"))  # noqa: E731, B023
        into = (both.groupBy("a").agg(F.min(ranked("b")).alias("best"))
                .select(F.col("a").alias("old"), F.least(ranked("a"), "best")["to"].alias("new")))
        into = materialize(into, "group-merges")
        labels = materialize(labels.join(into, F.col("group") == F.col("old"), "left")
                             .select("node", F.coalesce("new", "group").alias("group")), "group-labels")
        a, b = into.toDF("a", "x"), into.toDF("b", "y")
        edges = materialize(edges.join(a, "a").join(b, "b").filter("x <> y")
                            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "group-edges")
        turn += 1
    return labels


OUTCOME = "seq long, uid long, born long, matches int"


def _replay(changes: pa.Table, users: pa.Table) -> pa.Table:
    """The changes of some groups, in seq order. A user is (id, None), or
    (None, seq of the change that made it)."""
    held: dict[tuple[int | None, int | None], tuple[str | None, str | None]] = {}
    owner: tuple[dict, dict] = ({}, {})                       # of each e-mail, of each name: the users who hold it

    def hold(who, names) -> None:
        for of, name in zip(owner, held.get(who, (None, None))):
            if name in of:
                of[name].discard(who)
        held[who] = names
        for of, name in zip(owner, names):
            if name:
                of.setdefault(name, set()).add(who)

    for row in users.to_pylist():
        hold((row["uid"], row["born"]), (row["email"], row["username"]))
    out = []
    for row in changes.sort_by("seq").to_pylist():
        found = owner[0].get(row["email"], set()) | owner[1].get(row["username"], set())
        who = (None, None)
        if len(found) < 2:
            who = next(iter(found), (None, row["seq"]))
            hold(who, (row["email"], row["username"]))
        out.append({"seq": row["seq"], "uid": who[0], "born": who[1], "matches": len(found)})
    return pa.Table.from_pylist(out, schema=pa.schema([("seq", pa.int64()), ("uid", pa.int64()), ("born", pa.int64()), ("matches", pa.int32())]))


def replay(users: DataFrame, changes: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """What each change meets: ``seq``, ``uid`` (the stored user it updates) or
    ``born`` (the seq of the change that made the user: its own if it inserts),
    and ``matches`` (users it finds; with two or more it has no effect).

    ``users``: uid, email, username; ``changes``: seq (distinct), email,
    username (neither null nor empty).
    """
    edges = changes.select(_node("e", "email").alias("a"), _node("n", "username").alias("b"))
    met = (users.join(changes.select("email").distinct(), "email", "left_semi")
           .unionByName(users.join(changes.select("username").distinct(), "username", "left_semi")).dropDuplicates(["uid"]))
    met = materialize(met.select("uid", F.lit(None).cast("long").alias("born"), "email", "username"), "identity-users")
    alone = F.coalesce(F.col("email"), F.lit("")) != "", F.coalesce(F.col("username"), F.lit("")) != ""
    nodes = (F.when(alone[0], _node("e", "email")), F.when(alone[1], _node("n", "username")))
    tied = met.select(F.coalesce(*nodes).alias("a"), F.coalesce(*nodes[::-1]).alias("b"))
    label = groups(edges.unionByName(tied))
    changes = changes.withColumn("node", _node("e", "email")).join(label, "node").drop("node")
    state = met.withColumn("node", F.coalesce(*nodes)).join(label, "node").drop("node")
    order = Window.partitionBy("group").orderBy("seq")
    changes = materialize(changes.withColumn("run", F.floor((F.row_number().over(order) - 1) / at_once)), "identity-changes")
    runs = changes.groupBy("run").agg(F.count("*").alias("n")).collect()          # one row a run
    outcomes = None
    for run, n in sorted((r.run, r.n) for r in runs):
        now = changes.filter(F.col("run") == run)
        bucket = F.pmod(F.xxhash64("group"), F.lit(1 + n // at_once))
        found = (now.withColumn("bucket", bucket).groupBy("bucket").cogroup(state.withColumn("bucket", bucket).groupBy("bucket"))
                 .applyInArrow(lambda a, b: _replay(a, b), OUTCOME))
        found = materialize(found, "identity-outcomes")
        outcomes = found if outcomes is None else outcomes.unionByName(found)
        if run + 1 < len(runs):
            took = (now.join(found.filter("matches < 2").drop("matches"), "seq").groupBy("uid", "born")
                    .agg(F.max_by(F.struct("email", "username", "group"), "seq").alias("s")).select("uid", "born", "s.*"))
            same = state["uid"].eqNullSafe(took["uid"]) & state["born"].eqNullSafe(took["born"])
            state = materialize(state.join(took, same, "left_anti").unionByName(took), "identity-users")
    if outcomes is None:
        outcomes = users.sparkSession.createDataFrame([], OUTCOME)
    return outcomes
