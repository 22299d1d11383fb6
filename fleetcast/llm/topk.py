"""Exact top-k inner product search with two cover trees.

Data and queries are cut into blocks of near vectors, and each block is
indexed by a cover tree: a node has a centre, a covering radius (the distance
of its farthest point) and children whose centres cover its points at a
smaller scale. A search walks a tree of queries and a tree of data together.
No pair of points below two nodes has an inner product over

    <cq, cd> + |cq| rd + |cd| rq + rq rd,

so a node pair is passed over when that is less than the worst kth score among
the node's queries. All components are integers, and so are the scores.

Two rounds: first each query searches the one block that it would lie in, for
a good kth score to start from. Then each block of queries meets each block of
data that the bound of their roots leaves. Blocks have a bounded size: a dense
region, or many equal vectors, make more blocks and not larger ones.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcast.llm.common import bounded_batches, materialize, table

K, SCALE, EVERY = 5, 256, 50
PIVOTS = 64                    # sampled rows that cells are drawn around
BLOCK, QUERY_BLOCK = 4096, 1024
LEAF, QUERY_LEAF, BASE = 64, 16, 1.5
EXACT = 2.0 ** 53              # float64 adds integers exactly up to here


class CoverTree:
    """Nodes over the rows of ``x``. ``order[lo:hi]`` are a node's points;
    ``kids`` its children (none: a leaf). Node 0 is the root."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.leaf, self.small = leaf, max(leaf // 4, 2)
        self.x = np.asarray(x, float)
        self.square = (self.x ** 2).sum(1)
        self.order = np.zeros(0, np.int64)
        self.centre, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        everything = np.arange(len(self.x))
        far = ((self.x - self.x.mean(0)) ** 2).sum(1)
        self._node(everything, int(far.argmin()), 0)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.c = self.x[self.centre]
        self.norm = np.sqrt((self.c ** 2).sum(1))
        self.kids = [np.array(k, np.int64) for k in self.kids]

    def _distance(self, points: np.ndarray, centre: int) -> np.ndarray:
        """Exact for integers below 2 ** 26, up to rounding of the root."""
        d = self.square[points] - 2 * (self.x[points] @ self.x[centre]) + self.square[centre]
        return np.sqrt(np.maximum(d, 0))

    def _new(self, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius * (1 + 1e-9))
        self.lo.append(len(self.order))
        self.hi.append(0)
        self.kids.append([])
        return len(self.centre) - 1

    def _leaves(self, points: np.ndarray) -> list[int]:
        """Leaves of at most ``leaf`` points, in the given order, each around its
        first point."""
        made = []
        for a in range(0, len(points), self.leaf):
            some = points[a:a + self.leaf]
            made.append(self._new(int(some[0]), float(self._distance(some, some[0]).max())))
            self.order = np.append(self.order, some)
            self.hi[made[-1]] = len(self.order)
        return made

    def _node(self, points: np.ndarray, centre: int, depth: int) -> int:
        distance = self._distance(points, centre)
        radius = float(distance.max())
        if len(points) <= self.leaf:
            return self._leaves(points[np.argsort(distance, kind="stable")])[0]
        me = self._new(centre, radius)
        # farthest-first centres until all points are covered at the next scale; points that need a
        # centre for every few of them have no structure at this scale and go to leaves
        scale, nearest, of = radius / BASE, distance.copy(), np.zeros(len(points), np.int64)
        centres, own = [centre], self.x[points]
        square = self.square[points]
        while radius > 0 and nearest.max() > scale and len(centres) * self.small < 2 * len(points) and depth < 40:
            pick = int(points[nearest.argmax()])
            d = np.sqrt(np.maximum(square - 2 * (own @ self.x[pick]) + self.square[pick], 0))
            closer = d < nearest
            of[closer], nearest[closer] = len(centres), d[closer]
            centres.append(pick)
        sizes = np.bincount(of, minlength=len(centres))
        whole = (sizes >= self.small) & (sizes < len(points))
        for k in np.flatnonzero(whole):
            self.kids[me].append(self._node(points[of == k], centres[k], depth + 1))
        rest = np.flatnonzero(~whole[of])
        if len(rest):
            self.kids[me] += self._leaves(points[rest[np.argsort(of[rest], kind="stable")]])
        self.hi[me] = len(self.order)
        return me


class Search:
    """k best data rows for each query row. ``floor``: scores that are known
    to be reached; what lies below is passed over."""

    def __init__(self, queries: CoverTree, query_ids, data: CoverTree, data_ids, k: int, floor=None):
        self.q, self.d, self.k = queries, data, k
        self.query_ids, self.data_ids = np.asarray(query_ids, np.int64), np.asarray(data_ids, np.int64)
        n = len(self.query_ids)
        self.floor = np.full(n, -np.inf) if floor is None else np.asarray(floor, float)
        self.score, self.best = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        most = np.abs(queries.x).max(initial=0) * np.abs(data.x).max(initial=0) * queries.x.shape[1]
        self.points, self.large = 0, most >= EXACT
        if self.large:
            self.by_integers()
        else:
            self.walk(0, 0)

    def worst(self, q: int) -> float:
        """The least kth score among the queries below a node."""
        rows = self.q.order[self.q.lo[q]:self.q.hi[q]]
        return np.maximum(self.score[rows, -1], self.floor[rows]).min()

    def bound(self, q: int, d) -> np.ndarray:
        t, u = self.q, self.d
        b = u.c[d] @ t.c[q] + t.norm[q] * u.radius[d] + u.norm[d] * t.radius[q] + t.radius[q] * u.radius[d]
        return b + 1e-6 * (1 + np.abs(b))

    def compare(self, q: int, points: np.ndarray) -> None:
        """All queries of a leaf against some data rows."""
        rows = self.q.order[self.q.lo[q]:self.q.hi[q]]
        s = np.rint(self.q.x[rows] @ self.d.x[points].T)
        s[self.query_ids[rows][:, None] == self.data_ids[points][None, :]] = -np.inf
        self.points += s.size
        s = np.hstack([self.score[rows], s])
        ids = np.hstack([self.best[rows], np.broadcast_to(self.data_ids[points], (len(rows), len(points)))])
        first = np.lexsort((ids, -s), axis=1)[:, :self.k]
        self.score[rows], self.best[rows] = np.take_along_axis(s, first, 1), np.take_along_axis(ids, first, 1)

    def walk(self, q: int, d: int) -> None:
        todo = [(q, d, np.inf)]
        while todo:
            q, d, bound = todo.pop()
            worst = self.worst(q)
            if bound < worst:
                continue
            if len(self.q.kids[q]) and (self.q.radius[q] >= self.d.radius[d] or not len(self.d.kids[d])):
                todo += [(int(k), d, float(self.bound(int(k), np.array([d]))[0])) for k in self.q.kids[q]]
                continue
            kids = self.d.kids[d] if len(self.d.kids[d]) else np.array([d])
            bounds = self.bound(q, kids)
            kids, bounds = kids[bounds >= worst], bounds[bounds >= worst]
            if not len(self.q.kids[q]):
                leaf = np.array([not len(self.d.kids[k]) for k in kids], bool)
                if leaf.any():
                    self.compare(q, np.concatenate([self.d.order[self.d.lo[k]:self.d.hi[k]] for k in kids[leaf]]))
                kids, bounds = kids[~leaf], bounds[~leaf]
            # the most promising child comes first off the stack
            todo += [(q, int(kids[i]), float(bounds[i])) for i in np.argsort(bounds)]

    def by_integers(self) -> None:
        """All rows against all, for components whose products float64 rounds."""
        whole = lambda x: [[int(c) for c in row] for row in x.tolist()]
        data, self.found = whole(self.d.x), []
        for who, q, floor in zip(self.query_ids.tolist(), whole(self.q.x), self.floor.tolist()):
            scored = [(-sum(a * b for a, b in zip(q, d)), i) for i, d in zip(self.data_ids.tolist(), data) if i != who]
            self.found += [(who, i, -s) for s, i in heapq.nsmallest(self.k, scored) if -s >= floor]

    def rows(self) -> tuple:
        """(query id, data id, score) of the found rows that reach the floor."""
        if self.large:
            return tuple(zip(*self.found)) or ((), (), ())
        found = np.isfinite(self.score) & (self.score >= self.floor[:, None])
        who = np.broadcast_to(self.query_ids[:, None], found.shape)
        return who[found], self.best[found], self.score[found].astype(np.int64)


HITS = "query_id long, vec_id long, score decimal(38,0)"
MOST = 10 ** 38 - 1


def hits(found: tuple) -> dict[str, pa.Array]:
    """Scores of more than 38 digits are taken for the largest of 38."""
    who, ids, score = found
    return {"query_id": pa.array(who, pa.int64()), "vec_id": pa.array(ids, pa.int64()),
            "score": pa.array([Decimal(max(min(int(s), MOST), -MOST)) for s in score], pa.decimal128(38, 0))}


def vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id`` and ``v``: floor(scale * x) of each component as double. Rows
    with a null id, a null or empty vector, or a component that is null or not
    finite (also once scaled) are left out."""
    good = F.forall("y", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    down = F.transform("y", lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c))      # larger ones are integers
    return (rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"))
            .filter(F.col("id").isNotNull() & (F.size("x") > 0))
            .withColumn("y", F.transform("x", lambda c: c.cast("double") * scale)).filter(good).select("id", down.alias("v")))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def with_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``cell``: the dimension and the nearest pivot of that dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, cells = batch.column(batch.schema.get_field_index("v")), np.zeros(batch.num_rows, object)
            size = np.array([len(x) for x in v])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x, p = matrix(v.take(pa.array(at))), pivots.get(int(d))
                near = np.zeros(len(at), int) if p is None else ((p ** 2).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
                cells[at] = [f"{d}:{k}" for k in near]
            yield batch.append_column("cell", pa.array(cells.tolist(), pa.string()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, cell string")


def block_of(counts: dict[str, int], size: int) -> tuple[Column, int]:
    """The block number of a row from its cell: small neighbouring cells of a
    dimension share a block, large ones are dealt over several by hash."""
    first, parts, n, room, last = {}, {}, 0, 0, None
    for cell in sorted(counts, key=lambda c: tuple(map(int, c.split(":")))):
        dim, need = cell.split(":")[0], counts[cell]
        if need > size:
            first[cell], parts[cell] = n, -(-need // size)
            n, room = n + parts[cell], 0
        else:
            if room < need or dim != last:
                n, room = n + 1, size
            first[cell], parts[cell], room = n - 1, 1, room - need
        last = dim
    if not counts:
        return F.lit(0), 0
    of = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("cell")]
    return (of(first) + F.pmod(F.xxhash64("id", F.lit(3)), of(parts))).cast("int"), n


def trees(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row per block: its root's centre and radius, and the pickled tree
    with the ids (and floors) of its points. ``rows``: block, id, v, floor."""
    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        tree = CoverTree(matrix(group["v"].combine_chunks()), leaf)
        blob = pickle.dumps((tree, group["id"].to_numpy(), group["floor"].to_numpy()))
        return pa.table({"block": group["block"][:1], "dim": pa.array([tree.x.shape[1]], pa.int32()),
                         "centre": [tree.c[0].tolist()], "radius": [float(tree.radius[0])], "tree": pa.array([blob], pa.binary())})

    return rows.select("block", "id", "v", "floor").groupBy("block").applyInArrow(
        build, "block int, dim int, centre array<double>, radius double, tree binary")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(data: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K,
          scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each query
    the k rows of ``data`` with the largest inner product of the scaled vectors,
    ties to the smaller id; all rows if there are fewer.

    Rows with the query's own id aren't its candidates. A query id that occurs
    more than once is answered for its smallest vector; data rows that repeat
    each count. Only vectors of one length are compared. Null ids, null or
    empty vectors and vectors with null or non-finite components take no part.
    Large components are scored with Python integers; a score beyond the range
    of a long is ranked exactly (up to 38 digits) and given as the range's end.
    Empty tables give an empty result.
    """
    spark = data.sparkSession
    bounded_batches(spark)
    d = vectors(data, key, vector, scale)
    q = vectors(queries, key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    pivots: dict[int, list] = {}
    for r in d.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOTS).collect():
        pivots.setdefault(len(r.v), []).append(r.v)
    fixed = {n: np.array(v) for n, v in pivots.items()}
    d = materialize(with_cells(d, fixed), "topk-cells")
    q = materialize(with_cells(q, fixed), "topk-queries")
    count = lambda x: {r.cell: r.n for r in x.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # noqa: E731  PIVOTS rows a dimension
    of_data, n_data = block_of(count(d), block)
    index = materialize(trees(d.withColumn("block", of_data).withColumn("floor", F.lit(float("-inf")))), "topk-index")

    def home(group: pa.Table, found: pa.Table) -> pa.Table:
        if not len(group) or not len(found):
            return pa.table(hits(((), (), ())))
        tree, ids, _ = pickle.loads(found["tree"][0].as_py())
        group = group.combine_chunks()
        return pa.table(hits(Search(CoverTree(matrix(group["v"].combine_chunks()), QUERY_LEAF), group["id"].to_numpy(), tree, ids, k).rows()))

    # a query goes to the block that a row like it would be in; its cell has data or not
    first = materialize(
        q.withColumn("block", of_data).filter("block is not null").select("block", "id", "v").groupBy("block")
        .cogroup(index.select("block", "tree").groupBy("block")).applyInArrow(home, HITS), "topk-home")
    floor = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    of_query, n_query = block_of(count(q), query_block)
    least = F.col("least").cast("double")
    least = F.when(F.abs(least) < EXACT, least).otherwise(least - F.abs(least) * 1e-12)       # never above the score itself
    floored = (q.join(floor, F.col("id") == F.col("query_id"), "left")
               .withColumn("floor", F.when(F.col("n") >= k, least).otherwise(F.lit(float("-inf")))))
    groups = materialize(trees(floored.withColumn("block", of_query), QUERY_LEAF), "topk-query-trees")
    if not n_query or not n_data:
        return first.select("query_id", F.lit(1).alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))

    worst = (floored.withColumn("block", of_query).groupBy("block").agg(F.min("floor").alias("worst")))
    heads = (groups.join(worst, "block").select(F.col("block").alias("q"), F.col("dim").alias("q_dim"),
                                                F.col("centre").alias("qc"), F.col("radius").alias("qr"), "worst"))
    norm = lambda c: F.sqrt(_dot(F.col(c), F.col(c)))
    bound = _dot(F.col("qc"), F.col("dc")) + norm("qc") * F.col("dr") + norm("dc") * F.col("qr") + F.col("qr") * F.col("dr")
    pairs = (index.select(F.col("block").alias("b"), F.col("dim").alias("d_dim"), F.col("centre").alias("dc"), F.col("radius").alias("dr"))
             .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))).join(heads, "q")
             .filter("q_dim = d_dim").filter(bound + F.abs(bound) * 1e-6 + 1e-6 >= F.col("worst")).select("q", "b"))
    work = (pairs.join(index.select(F.col("block").alias("b"), F.col("tree").alias("data")), "b")
            .join(groups.select(F.col("block").alias("q"), F.col("tree").alias("queries")), "q").select("data", "queries"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data_, queries_ in zip(batch.column(0), batch.column(1)):
                tree, ids, _ = pickle.loads(data_.as_py())
                mine, who, floors = pickle.loads(queries_.as_py())
                yield pa.RecordBatch.from_pydict(hits(Search(mine, who, tree, ids, k, floors).rows()))

    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    clipped = F.greatest(F.least("score", F.lit(2 ** 63 - 1)), F.lit(-2 ** 63)).cast("long")
    return (work.mapInArrow(search, HITS).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", clipped.alias("score")))


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
