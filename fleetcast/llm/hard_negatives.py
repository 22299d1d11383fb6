"""Hard negatives by threshold joins over dense inverted indexes.

For an anchor, the positives are its best rows of the same label, and a hard
negative of a positive is a row of another label whose score lies in a window
below the positive's. Both come from joins "all rows whose inner product with
the anchor reaches a threshold", in the manner of L2AP:

* Rows are in blocks. In a block, dimensions are taken in order of their
  weight, ``CHUNK`` at a time, and the norm of what is left of a row (its
  suffix) is known after each chunk. A row is indexed only up to the chunk
  where its suffix norm times the largest suffix norm of the anchors falls
  below the least threshold; rows are sorted by that length, so the posting
  list of a chunk is the first part of a matrix.
* Partial scores are added up chunk by chunk. A pair goes as soon as its
  partial score and the product of the norms that are left can't reach the
  threshold, or can't come down to the window any more. Few pairs that are
  left, and the pairs of rows that are not indexed further, are completed one
  by one.
* Thresholds start high and are lowered in steps until an anchor's windows are
  full. That happens in one block, whose kth scores bound the final ones; with
  these thresholds each anchor then meets all other blocks.

Rows of one label with equal vectors have equal scores, so only the smallest
ids among them can be returned; the others aren't indexed. Components are
integers; where float64 might not be exact, Python integers take over.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcast.llm.common import bounded_batches, materialize, table
from fleetcast.llm.numbering import numbered

SCALE, ANCHOR_EVERY = 256, 100
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90      # LOW and HIGH: percent of the positive's score
BITS, ANCHOR_BITS = 13, 8                            # rows of a block, anchors of a block: 2^bits
TOGETHER = 32                                        # blocks of anchors that meet a block in one task
SLICE, CHUNK = 2048, 16
FEW = 0.02                                           # share of pairs left at which they are completed one by one
EXACT = 2 ** 53                                      # float64 adds integers exactly up to here
SAFE = 1 + 1e-9                                      # for rounding of norms
NONE = -10 ** 38                                     # a threshold that every score reaches
STEPS = (0.5, 0.25, 0.125, 0.0625)                   # of the largest possible score, for positives
PARTS = (1 / 16, 1 / 8, 1 / 4, 1 / 2)                # of the way to the window's lower end, for negatives


@dataclass
class Block:
    """Some rows: ids, labels, and vectors of integers (float64, or Python
    integers where they are large). Anchors have ``who`` (their number), the
    threshold ``low`` of each and, for negatives, ``windows``: positive's id,
    lowest and highest score, positive's score."""
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    who: np.ndarray | None = None
    low: list[int] | None = None
    windows: list[list[tuple[int, int, int, int]]] | None = None

    def pack(self) -> bytes:
        x = self.x
        if x.dtype != object:
            most = np.abs(x).max(initial=0)
            x = x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)
        return pickle.dumps((self.ids, self.labels, x, self.who, self.low, self.windows))

    @classmethod
    def unpack(cls, raw: bytes) -> Block:
        ids, labels, x, *rest = pickle.loads(raw)
        return cls(ids, labels, x if x.dtype == object else x.astype(float), *rest)

    def some(self, at: np.ndarray) -> Block:
        return Block(self.ids[at], self.labels[at], self.x[at], self.who[at], None, [self.windows[i] for i in at] if self.windows else None)


def integers(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if np.abs(x).max(initial=0) < EXACT:
        return x
    return np.array([[int(c) for c in row] for row in x.tolist()], object)


class Index:
    """A block's rows, in slices, with suffix norms."""

    def __init__(self, block: Block):
        self.block = block
        self.wide = block.x.dtype == object
        if self.wide:
            return
        weight = (block.x ** 2).sum(0)
        self.order = np.argsort(-weight, kind="stable")
        x = block.x[:, self.order]
        self.ends = [*range(CHUNK, x.shape[1], CHUNK), x.shape[1]]
        self.x, self.rest, self.most = x, suffix_norms(x, self.ends), np.abs(x).max(initial=0)

    def pairs(self, q: np.ndarray, low: list[int], high: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, anchor, score) of all pairs with low <= score <= high of
        their anchor, a slice of rows at a time."""
        most = 0 if self.wide or q.dtype == object else np.abs(q).max(initial=0) * self.most * q.shape[1]
        if self.wide or q.dtype == object or most >= EXACT:
            whole = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)
            mine = whole(q).T
            for a in range(0, len(self.block.x), SLICE):
                s = whole(self.block.x[a:a + SLICE]) @ mine
                rows, cols = np.nonzero((s >= np.array(low, object)) & (s <= np.array(high, object)))
                yield rows + a, cols, s[rows, cols]
            return
        q = q[:, self.order]
        norms, low, high = suffix_norms(q, self.ends), np.array(low, float), np.array(high, float)
        # chunks of each row that are indexed: those before which its suffix could still reach a threshold
        length = np.full(len(self.x), len(self.ends))
        if len(low) and low.min() > 0:
            length = (self.rest[:, :-1] * norms[:, :-1].max(0) * SAFE + 1e-3 >= low.min()).sum(1)
        by_length = np.argsort(-length, kind="stable")
        for a in range(0, len(by_length), SLICE):
            yield from self._slice(by_length[a:a + SLICE], length, q, norms, low, high)

    def _slice(self, rows, length, q, norms, low, high):
        acc, begin = np.zeros((len(rows), len(q))), 0
        for c, end in enumerate(self.ends):
            n = int((length[rows] > c).sum())                # the posting lists of this chunk
            if n < len(rows):
                room = self.rest[rows[n:], c][:, None] * norms[:, c][None, :] * SAFE + 1e-3
                near = (acc[n:] + room >= low) & (acc[n:] - room <= high)
                yield self._complete(rows[n:], acc[n:], *np.nonzero(near), begin, q, low, high)
                rows, acc = rows[:n], acc[:n]
            if not n:
                return
            acc += self.x[rows, begin:end] @ q[:, begin:end].T
            begin = end
            if end < self.x.shape[1]:
                room = self.rest[rows, c + 1][:, None] * norms[:, c + 1][None, :] * SAFE + 1e-3
                alive = (acc + room >= low) & (acc - room <= high)
                if alive.mean() < FEW:
                    yield self._complete(rows, acc, *np.nonzero(alive), begin, q, low, high)
                    return
                some = alive.any(1)
                rows, acc = rows[some], acc[some]
        r, k = np.nonzero((acc >= low) & (acc <= high))
        yield rows[r], k, np.rint(acc[r, k]).astype(np.int64)

    def _complete(self, rows, acc, r, k, begin, q, low, high):
        score = acc[r, k]
        for a in range(0, len(r), 1 << 16):
            part = slice(a, a + (1 << 16))
            score[part] += np.einsum("ij,ij->i", self.x[rows[r[part]], begin:], q[k[part], begin:])
        good = (score >= low[k]) & (score <= high[k])
        return rows[r[good]], k[good], np.rint(score[good]).astype(np.int64)


def suffix_norms(x: np.ndarray, ends: list[int]) -> np.ndarray:
    """Norm of each row from the beginning, and behind each chunk."""
    squares = np.add.reduceat(x ** 2, [0, *ends[:-1]], axis=1) if x.size else np.zeros((len(x), len(ends)))
    left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([left, np.zeros((len(x), 1))]))


Found = dict[tuple[int, int], list[tuple[int, int]]]         # (anchor, window) -> best (-score, id), in order


def best(found: Found, key: tuple[int, int], score: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Enters candidates of one window; the k best stay."""
    if len(score) > k:                                       # the kth score, then the smallest ids among its equals
        kth = np.sort(score)[-k]
        above, equal = score > kth, np.flatnonzero(score == kth)
        equal = equal[np.argsort(ids[equal], kind="stable")[:k]]
        at = np.concatenate((np.flatnonzero(above), equal))
        score, ids = score[at], ids[at]
    new = [(-s, i) for s, i in zip(score.tolist(), ids.tolist())]
    found[key] = sorted(found.get(key, []) + new)[:k]


def groups(k: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(k, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
        if len(part):
            yield int(k[part[0]]), part


def join_positives(index: Index, anchors: Block, low: list[int], k: int) -> Found:
    """The k best rows of the anchor's label that reach ``low``."""
    found: Found = {}
    d = index.block
    for rows, cols, score in index.pairs(anchors.x, low, [-NONE] * len(low)):
        own = (d.labels[rows] == anchors.labels[cols]) & (d.ids[rows] != anchors.ids[cols])
        rows, cols, score = rows[own], cols[own], score[own]
        for i, at in groups(cols):
            best(found, (i, 0), score[at], d.ids[rows[at]], k)
    return found


def join_negatives(index: Index, anchors: Block, low: list[int], k: int) -> Found:
    """The k best rows of other labels in each window that reach ``low``."""
    found: Found = {}
    d = index.block
    high = [max((w[2] for w in windows), default=NONE) for windows in anchors.windows]
    for rows, cols, score in index.pairs(anchors.x, low, high):
        other = (d.labels[rows] != anchors.labels[cols]) & (d.ids[rows] != anchors.ids[cols])
        rows, cols, score = rows[other], cols[other], score[other]
        for i, at in groups(cols):
            s, ids = score[at], d.ids[rows[at]]
            for j, (_, least, most, _) in enumerate(anchors.windows[i]):
                inside = (s >= least) & (s <= most)
                if inside.any():
                    best(found, (i, j), s[inside], ids[inside], k)
    return found


def lowered_positives(index: Index, anchors: Block, k: int) -> list[int]:
    """A score that k positives of each anchor reach: thresholds are lowered
    until there are k in this block. NONE where it hasn't as many."""
    low, todo = [NONE] * len(anchors.ids), np.arange(len(anchors.ids))
    norm = np.sqrt(np.array((anchors.x ** 2).sum(1), float))
    longest = np.sqrt(np.array((index.block.x ** 2).sum(1), float)).max(initial=0)
    for step in (*STEPS, None):
        if not len(todo):
            break
        tried = [NONE if step is None else int(step * n * longest) for n in norm[todo]]
        found = join_positives(index, anchors.some(todo), tried, k)
        full = [len(found.get((i, 0), ())) == k for i in range(len(todo))]
        for i in np.flatnonzero(full):
            low[todo[i]] = -found[int(i), 0][-1][0]
        todo = todo[~np.array(full, bool)]
    return low


def lowered_negatives(index: Index, anchors: Block, k: int) -> list[int]:
    """A score above which no window of an anchor can still be short: lowered
    until each has k rows of this block, or to the windows' lowest end."""
    floor = [min((w[1] for w in windows), default=-NONE) for windows in anchors.windows]
    start = [min((w[2] for w in windows), default=-NONE) for windows in anchors.windows]
    low, todo = list(floor), np.array([i for i, windows in enumerate(anchors.windows) if windows], np.int64)
    for part in PARTS:
        if not len(todo):
            break
        tried = [start[i] - int((start[i] - floor[i]) * part) for i in todo]
        some = anchors.some(todo)
        found = join_negatives(index, some, tried, k)
        full = []
        for i, windows in enumerate(some.windows):
            lists = [found.get((i, j), []) for j in range(len(windows))]
            done = all(len(x) == k or w[1] >= tried[i] for x, w in zip(lists, windows))
            full.append(done)
            if done:
                low[todo[i]] = min(max(w[1], -x[-1][0]) if len(x) == k else w[1] for x, w in zip(lists, windows))
        todo = todo[~np.array(full, bool)]
    return low


def usable(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``id``, ``label`` (as text), ``v`` (integers, as doubles) and ``tree``
    (the vector's length) of the rows that take part."""
    scaled = F.transform("x", lambda c: c.cast("double") * scale)
    good = F.forall("y", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    down = F.transform("y", lambda c: F.when(F.abs(c) < float(EXACT), F.floor(c).cast("double")).otherwise(c) + 0.0)
    return (rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("x"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)).withColumn("y", scaled).filter(good)
            .select("id", "label", down.alias("v"), F.size("x").cast("string").alias("tree")))


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Without the rows that can't be among the k best of any anchor: of equal
    vectors of a label the smallest ids win, and an anchor passes over one id."""
    of_id = W.partitionBy("tree", "label", "v", "id").orderBy("id")
    of_vector = W.partitionBy("tree", "label", "v").orderBy("id")
    return (rows.withColumn("again", F.row_number().over(of_id)).filter(F.col("again") <= k)
            .withColumn("again", F.row_number().over(of_vector)).filter(F.col("again") <= 2 * k).drop("again"))


def _pack(group: pa.Table) -> Block:
    group = group.sort_by("pos").combine_chunks()
    return Block(group["id"].to_numpy(), np.array(group["label"].to_pylist(), object), integers(group["v"].combine_chunks()))


def packed(rows: DataFrame, bits: int) -> DataFrame:
    """One row per block: ``tree``, ``block``, first and last label, ``blob``."""
    def write(group: pa.Table) -> pa.Table:
        block = _pack(group)
        return pa.table({"tree": group["tree"][:1], "block": group["block"][:1], "first": [min(block.labels)], "last": [max(block.labels)],
                         "blob": pa.array([block.pack()], pa.binary())})

    return (numbered(rows.withColumn("spread", F.xxhash64("id", "v")), ["label", "spread"]).withColumn("block", F.shiftright("pos", bits))
            .select("tree", "block", "pos", "id", "label", "v").groupBy("tree", "block")
            .applyInArrow(write, "tree string, block long, first string, last string, blob binary"))


def anchor_blocks(anchors: DataFrame, low: int = 0, high: int = 0) -> DataFrame:
    """One row per block of anchors: ``tree``, ``a``, labels and ``blob``. Where
    the rows have ``least`` or ``best`` (positives: score, id), the block has
    these thresholds and windows."""
    extra = [c for c in ("least", "best") if c in anchors.columns]

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos").combine_chunks()
        block = _pack(group)
        block.who = group["pos"].to_numpy()
        if "least" in extra:
            block.low = [NONE if x is None else int(x) for x in group["least"].to_pylist()]
        if "best" in extra:
            scored = [[(r["found"], int(r["score"])) for r in best] for best in group["best"].to_pylist()]
            block.windows = [[(i, -(-low * s // 100), high * s // 100, s) for i, s in best if low * s <= high * s] for best in scored]
        return pa.table({"tree": group["tree"][:1], "a": group["a"][:1], "first": [min(block.labels)], "last": [max(block.labels)],
                         "blob": pa.array([block.pack()], pa.binary())})

    return (anchors.select("tree", "a", "pos", "id", "label", "v", *extra).groupBy("tree", "a")
            .applyInArrow(write, "tree string, a long, first string, last string, blob binary"))


def meet(index: DataFrame, blocks: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """``run(index, anchors)`` gives rows for each of ``pairs`` (tree, block,
    a). A block of rows moves once for every TOGETHER blocks of anchors."""
    pairs = pairs.withColumn("group", (F.col("a") / TOGETHER).cast("long"))
    data = pairs.select("tree", "block", "group").distinct().join(index.select("tree", "block", "blob"), ["tree", "block"])
    asked = pairs.join(blocks.select("tree", "a", F.col("blob").alias("anchors")), ["tree", "a"]).select("tree", "block", "group", "anchors")

    def work(data: pa.Table, asked: pa.Table) -> pa.Table:
        found = Index(Block.unpack(data["blob"][0].as_py()))
        return pa.concat_tables([run(found, Block.unpack(a.as_py()), asked["tree"][0].as_py()) for a in asked["anchors"]])

    data = data.select("tree", "block", "group", "blob").toDF("t", "b", "g", "blob")
    return data.groupBy("t", "b", "g").cogroup(asked.groupBy("tree", "block", "group")).applyInArrow(work, schema)


SCORE = pa.decimal128(38, 0)


def _scores(values: list[int]) -> pa.Array:
    """Scores of more than 38 digits are taken for the largest."""
    return pa.array([Decimal(max(min(int(v), -NONE - 1), NONE + 1)) for v in values], SCORE)


def mine(rows: DataFrame, anchors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
         bits: int = BITS, anchor_bits: int = ANCHOR_BITS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``: for each anchor and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score``. Ties go to the smaller id; where there are fewer, all.

    A positive without such rows (always, if its score is negative) gives none.
    Rows of the anchor's own id aren't its candidates; apart from that, rows
    that repeat each count, and anchors that repeat are each answered. Only
    vectors of one length are compared. Rows with a null id, label, vector or
    component, an empty vector, or a component that is not finite (also once
    scaled) take no part. Scores beyond the range of a long are given as its
    end. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    kept = distinct_enough(usable(rows, key, vector, label, scale), max(positives, negatives))
    index = materialize(packed(kept, bits), "negatives-index")
    asked = numbered(usable(anchors, key, vector, label, scale).withColumn("spread", F.xxhash64("id", "v")), ["label", "spread"])
    asked = materialize(asked.withColumn("a", F.shiftright("pos", anchor_bits)), "negatives-anchors")
    blocks = materialize(anchor_blocks(asked), "negatives-anchor-blocks")

    counts = index.groupBy("tree").agg(F.count("*").alias("n"))
    pairs = (blocks.select("tree", "a", F.col("first").alias("a_first"), F.col("last").alias("a_last")).join(counts, "tree")
             .withColumn("block", F.explode(F.expr("sequence(0L, n - 1)"))))
    pairs = materialize(pairs.join(index.select("tree", "block", "first", "last"), ["tree", "block"]), "negatives-pairs")
    same = pairs.filter("first <= a_last and a_first <= last")
    # the thresholds come from one block: the first of the anchors' label, or the one farthest from it
    nearest = W.partitionBy("tree", "a").orderBy("block")
    one = same.withColumn("r", F.row_number().over(nearest)).filter("r = 1").select("tree", "a", "block", "n")
    far = one.withColumn("block", F.expr("(block + n div 2) % n"))

    def bounds(lowered, k: int, blocks: DataFrame, at: DataFrame) -> DataFrame:
        def work(found: Index, block: Block, tree: str) -> pa.Table:
            return pa.table({"tree": pa.array([tree] * len(block.who), pa.string()), "pos": pa.array(block.who, pa.int64()),
                             "least": _scores(lowered(found, block, k))})

        return meet(index, blocks, at, work, "tree string, pos long, least decimal(38,0)")

    def hits(join, k: int, blocks: DataFrame, at: DataFrame) -> DataFrame:
        def work(found: Index, block: Block, tree: str) -> pa.Table:
            out = [(int(block.who[i]), j, x, -s) for (i, j), rows in join(found, block, block.low, k).items() for s, x in rows]
            who, window, ids, score = zip(*out) if out else ((),) * 4
            return pa.table({"tree": pa.array([tree] * len(out), pa.string()), "pos": pa.array(who, pa.int64()),
                             "window": pa.array(window, pa.int32()), "found": pa.array(ids, pa.int64()), "score": _scores(score)})

        order = W.partitionBy("tree", "pos", "window").orderBy(F.desc("score"), "found")
        all_ = meet(index, blocks, at, work, "tree string, pos long, window int, found long, score decimal(38,0)")
        return all_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    least = bounds(lowered_positives, positives, blocks, one)
    blocks = materialize(anchor_blocks(asked.join(least, ["tree", "pos"])), "negatives-anchor-blocks")
    best_rows = materialize(hits(join_positives, positives, blocks, same), "negatives-positives")
    best_rows = best_rows.groupBy("tree", "pos").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "found"))).alias("best"))
    asked = materialize(asked.join(best_rows, ["tree", "pos"]), "negatives-windows")             # `positives` entries at most
    blocks = materialize(anchor_blocks(asked, low, high), "negatives-anchor-blocks")
    least = bounds(lowered_negatives, negatives, blocks, far)
    blocks = materialize(anchor_blocks(asked.join(least, ["tree", "pos"]), low, high), "negatives-anchor-blocks")
    found = hits(join_negatives, negatives, blocks, pairs)
    # windows were numbered without the positives that have none
    windows = asked.withColumn("best", F.filter("best", lambda b: b["score"] >= 0) if low < high else F.col("best")).select(
        "tree", "pos", F.col("id").alias("anchor_id"), F.posexplode("best").alias("window", "p"))
    clip = lambda c: F.greatest(F.least(c, F.lit(2 ** 63 - 1)), F.lit(-2 ** 63)).cast("long")
    return (windows.join(found, ["tree", "pos", "window"])
            .select("anchor_id", F.col("p.found").alias("positive_id"), "rank", F.col("found").alias("negative_id"),
                    clip(F.col("p.score")).alias("positive_score"), clip(F.col("score")).alias("negative_score")))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label)
    return mine(rows, rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM v AS a JOIN v AS c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v) WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
