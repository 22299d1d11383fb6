"""Random forest of two classes: growth from counts that Spark adds up over the rows.

Values are cut into ranges once, one byte each, and written with a hash a row; a
row takes part in a tree as often as a Poisson draw from that hash and the tree's
number says, so no draw is stored. All trees grow one level a pass: a task counts
rows by (tree, node, drawn feature, range, class), the counts of a tree meet in
one group, and the driver gets the best split of each node. Counts are whole
numbers: the forest does not depend on the order in which they are added up.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.operators.boosting import byte_matrix, byte_rows
from fleetcast.session import materialize

BINS = 32                  # quantile ranges a feature
FEW = 40                   # a feature of at most so many values has a range for each
SLOTS = 64                 # most ranges of a feature
CHUNK = 100_000            # rows that a task counts at once
COUNTS_MB = 256            # counts of a pass in a task; more trees take more passes
PART_ROWS, LEAST_ROWS = 1_000_000, 20_000     # rows a file of ranges
# a row is taken k times or more if its 16 bits are at least POISSON[k - 1] (mean 1)
POISSON = np.round(65536 * np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)])).astype(np.uint16)


class Forest(NamedTuple):
    """Trees as heaps (children of node i: 2i+1, 2i+2), one row each. ``feature``
    is -1 in a leaf; a row goes left if its value is at most ``cut``; nulls count
    as the feature's median. ``value``: the share of class 1."""
    features: list[str]
    medians: list[float]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


def _places(feature: np.ndarray, cut: np.ndarray, x: list[np.ndarray], n: int, level: int) -> np.ndarray:
    """The place of each row among the nodes of a level of one tree, from 0.
    Below a leaf, rows keep to the right."""
    at = np.zeros(n, dtype=np.min_scalar_type(2**level))
    for above in range(level):
        left = np.zeros(n, dtype=bool)
        for i in range(2**above):
            node = 2**above - 1 + i
            if feature[node] >= 0:
                left |= (at == i) & (x[feature[node]] <= cut[node])
        at = 2 * at + 1 - left
    return at


def _ranges(train: DataFrame, columns: dict[str, Column], label: str, edges: list[np.ndarray], n: int) -> DataFrame:
    """seed, bins: a byte a feature, twice the range plus the class."""
    def run(batches):
        for b in batches:
            y = b.column(0).to_numpy().astype(np.uint8)
            x = np.empty((b.num_rows, len(edges)), dtype=np.uint8)
            for i, e in enumerate(edges):
                x[:, i] = 2 * np.searchsorted(e, b.column(i + 2).to_numpy(zero_copy_only=False), side="left") + y
            # equal rows are drawn by their place in the batch too
            seed = pd.Series(b.column(1).to_numpy())
            h = seed.to_numpy().view(np.uint64)
            if seed.duplicated().any():
                h = h + seed.groupby(seed).cumcount().to_numpy().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), byte_rows(x)], ["seed", "bins"])
    # the hash is of the whole row, with keys where the frame has them
    rows = train.select(F.col(label).cast("int").alias("y"), F.xxhash64(*train.columns).alias("seed"),
                        *[c.alias(f"f{i}") for i, c in enumerate(columns.values())])
    files = min(max(train.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS)), -(-n // LEAST_ROWS))
    return materialize(rows.mapInArrow(run, "seed long, bins binary").repartition(files, "seed"), "forest-rows")


def _chunks(batches, width: int):
    """(seeds, a column of bytes for each feature) of about CHUNK rows."""
    seeds, bins, n = [], [], 0

    def whole():
        x = np.ascontiguousarray(np.concatenate(bins).T)
        return np.concatenate(seeds).view(np.uint64), list(x)
    for b in batches:
        seeds.append(b.column(0).to_numpy())
        bins.append(byte_matrix(b.column(1), width))
        n += b.num_rows
        if n >= CHUNK:
            yield whole()
            seeds, bins, n = [], [], 0
    if n:
        yield whole()


def _draws(seeds: np.ndarray, four: int, salt: int) -> np.ndarray:
    """How often each row of a chunk is taken by each of four trees."""
    h = (seeds + np.uint64((salt + 0x9E3779B97F4A7C15 * (four + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    u = np.ascontiguousarray((h ^ (h >> np.uint64(29))).view(np.uint16).reshape(-1, 4).T)
    times = np.zeros(u.shape, dtype=np.uint8)
    for least in POISSON:
        times += u >= least
    return times


def _best(counts: np.ndarray, weights: tuple[float, float]):
    """Of one node's counts by (drawn feature, range, class): its rows, then the
    place and range of the split with most gain in Gini impurity (-1: none) and the rows left of it."""
    left = counts.cumsum(axis=1)
    whole = left[0, -1]
    right = whole - left
    w = np.array(weights)

    def part(c):
        s = (c * w).sum(axis=-1)
        return ((c * w) ** 2).sum(axis=-1) / np.maximum(s, 1e-300)
    gain = (part(left) + part(right) - part(whole)) / max((whole * w).sum(), 1e-300)
    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), gain, 0.0)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    if gain[at] <= 1e-12:
        return (*whole, -1, 0, 0, 0)
    return (*whole, at[0], at[1], *left[at])


_SPLITS = "tree int, node int, n0 long, n1 long, place int, cut int, l0 long, l1 long"


def _level(rows: DataFrame, some: np.ndarray, feature, cut, drawn: np.ndarray, level: int, width: int, salt: int, weights) -> list:
    """The best split of each node of a level, for the trees ``some``."""
    first, nodes, places = 2**level - 1, 2**level, drawn.shape[2]
    size = 2 * SLOTS
    grows = np.ones((len(some), 1), dtype=bool) if not level else np.repeat(feature[some, first // 2:first] >= 0, 2, axis=1)
    # cuts are ranges: a byte holds twice the range and the class
    feature, byte = feature[some], (2 * cut[some] + 1).astype(np.uint8)

    def count(batches):
        total = np.zeros((len(some), nodes, places, size))      # whole numbers, exact as doubles
        for seeds, x in _chunks(batches, width):
            four, times = -1, None
            for t, tree in enumerate(some):
                if four != tree // 4:
                    four, times = tree // 4, _draws(seeds, int(tree // 4), salt)
                place, taken = _places(feature[t], byte[t], x, len(seeds), level), times[tree % 4]
                place = np.where(taken, place, place.dtype.type(nodes))         # rows that are not taken come last
                ends = np.bincount(place, minlength=nodes + 1)[:nodes].cumsum()
                order = np.argsort(place, kind="stable")[:ends[-1]]
                times_taken = taken[order].astype(float)
                for i in np.flatnonzero(grows[t]):
                    own = slice(ends[i - 1] if i else 0, ends[i])
                    for j, f in enumerate(drawn[t, i]):
                        total[t, i, j] += np.bincount(x[f][order[own]], times_taken[own], size)
        seen = np.flatnonzero(total.any(axis=(1, 2, 3)))
        yield pa.RecordBatch.from_arrays([pa.array(some[seen].astype(np.int32)), pa.array([total[t].astype(np.int64).tobytes() for t in seen], pa.binary())],
                                         ["tree", "counts"])

    def split(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int64) for c in group["counts"]).reshape(nodes, places, SLOTS, 2)
        found = [(key[0], first + i, *_best(c, weights)) for i, c in enumerate(total) if c.any()]
        return pd.DataFrame(found, columns=["tree", "node", "n0", "n1", "place", "cut", "l0", "l1"])
    return rows.mapInArrow(count, "tree int, counts binary").groupBy("tree").applyInPandas(split, _SPLITS).collect()


def fit_forest(train: DataFrame, features: list[str], medians: list[float], edges: list[np.ndarray], weights: dict[float, float], n: int,
               label: str = "label", trees: int = 200, max_depth: int = 5, seed: int = 42) -> Forest:
    """L2: ``trees`` trees of at most ``max_depth`` levels of splits, each on a
    bootstrap sample of all ``n`` rows, each split by the best of ceil(sqrt)
    features drawn for its node, classes weighted. ``train`` has labels 0 and 1
    only, and ``weights`` those that occur; ``edges``: inner edges of the ranges
    of each feature's values (at most SLOTS - 1)."""
    if not weights or not set(weights) <= {0.0, 1.0}:
        raise ValueError("two_classes: the forest takes labels 0 and 1")
    w = (weights.get(0.0, 1.0), weights.get(1.0, 1.0))
    columns = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(m))) for c, m in zip(features, medians)}
    rows = _ranges(train, columns, label, edges, n)
    width, places = len(features), int(np.ceil(np.sqrt(len(features))))
    rng = np.random.default_rng(seed)
    salt = int(rng.integers(2**63))
    shape = (trees, 2**(max_depth + 1) - 1)
    feature, cut_bin = np.full(shape, -1, dtype=np.int32), np.zeros(shape, dtype=np.int32)
    cut, value = np.zeros(shape), np.full(shape, 0.5)
    share = lambda a, b: w[1] * b / (w[0] * a + w[1] * b)     # noqa: E731
    for level in range(max(1, max_depth)):
        drawn = rng.random((trees, 2**level, width)).argsort(axis=2)[:, :, :places]
        grows = np.arange(trees) if not level else np.flatnonzero((feature[:, 2**(level - 1) - 1:2**level - 1] >= 0).any(axis=1))
        at_once = max(1, COUNTS_MB * 2**20 // (2**level * places * 2 * SLOTS * 8))
        for some in (grows[i:i + at_once] for i in range(0, len(grows), at_once)):
            for r in _level(rows, some, feature, cut_bin, drawn[some], level, width, salt, w):
                t, i = r.tree, r.node
                value[t, i] = share(r.n0, r.n1)
                if r.place >= 0 and level < max_depth:
                    f = drawn[t, i - 2**level + 1, r.place]
                    feature[t, i], cut_bin[t, i], cut[t, i] = f, r.cut, edges[f][r.cut]
                    value[t, 2 * i + 1], value[t, 2 * i + 2] = share(r.l0, r.l1), share(r.n0 - r.l0, r.n1 - r.l1)
    return Forest(list(features), [float(m) for m in medians], feature, cut, value)


def predict(model: Forest) -> Column:
    """The mean over the trees of the share of class 1 in the leaf of a row."""
    levels = int(np.log2(model.value.shape[1] + 1)) - 1
    value = model.value.copy()
    for i in range(2**levels - 1):        # the last place below a leaf has its value
        value[:, 2 * i + 2] = np.where(model.feature[:, i] < 0, value[:, i], value[:, 2 * i + 2])
    value = value[:, 2**levels - 1:]

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        cols = [x[c].to_numpy(dtype=float) for c in x.columns]
        total = np.zeros(len(x))
        for feature, cut, v in zip(model.feature, model.cut, value):
            total += v[_places(feature, cut, cols, len(x), levels)]
        return pd.Series(np.clip(total / len(value), 0.0, 1.0))
    return run(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)).alias(f"f{i}")
                          for i, (c, m) in enumerate(zip(model.features, model.medians))]))


def save_forest(spark: SparkSession, model: Forest, path: str) -> None:
    """A row a node and a row a feature."""
    nodes = [(t, i, int(f), float(c), float(v)) for t in range(len(model.value))
             for i, (f, c, v) in enumerate(zip(model.feature[t], model.cut[t], model.value[t]))]
    spark.createDataFrame(nodes, "tree int, node int, feature int, cut double, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    medians = [(i, c, m) for i, (c, m) in enumerate(zip(model.features, model.medians))]
    spark.createDataFrame(medians, "place int, feature string, median double").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_forest(spark: SparkSession, path: str) -> Forest:
    """A saved forest (trees x nodes rows)."""
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
    f = sorted(spark.read.parquet(f"{path}/features").collect())
    trees = nodes["tree"].nunique()
    return Forest([r.feature for r in f], [r.median for r in f], *(nodes[c].to_numpy().reshape(trees, -1) for c in ("feature", "cut", "value")))
