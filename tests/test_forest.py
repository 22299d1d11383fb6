"""Random forest: counts, splits and draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcast.operators import forest as FR
from fleetcast.operators import models as ML
from fleetcast.operators import training as L


def _train(spark, n=4000):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=n).round(3), rng.integers(0, 3, n)
    y = ((a > 0.2) ^ (b == 1)).astype(int)
    rows = [(i, float(a[i]) if i % 50 else None, float(b[i]), float(i % 7), None, int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, empty double, label int")


def test_forest_does_not_depend_on_partitions(spark, tmp_dir):
    t = _train(spark)
    one = ML.fit_cancellation(t.repartition(1), ["a", "b", "c", "empty"], trees=9, max_depth=3)
    five = ML.fit_cancellation(t.repartition(5), ["a", "b", "c", "empty"], trees=9, max_depth=3)
    assert one.features == ["a", "b", "c"] and one.value.shape == (9, 15)
    for x, y in zip(one[1:], five[1:]):
        assert np.array_equal(x, y)
    ML.save_model(spark, one, f"{tmp_dir}/m", "random_forest", one.features)
    back, _, _ = ML.load_model(spark, f"{tmp_dir}/m", "random_forest")
    assert back.features == one.features and all(np.array_equal(x, y) for x, y in zip(one[1:], back[1:]))


def test_scores_follow_the_trees_and_learn(spark):
    t = _train(spark)
    model = ML.fit_cancellation(t, ["a", "b", "c"], trees=20, max_depth=5)
    out = ML.score(model, t, ["a", "b", "c", "label"]).collect()
    for r in out[:200]:
        x = [m if v is None else v for v, m in zip((r.a, r.b, r.c), model.medians)]
        shares = []
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            i = 0
            while i < 31 and feature[i] >= 0:
                i = 2 * i + (1 if x[feature[i]] <= cut[i] else 2)
            shares.append(value[i])
        assert abs(np.mean(shares) - r.score) < 1e-9 and r.prediction == int(r.score > 0.5)
    assert np.mean([r.prediction == r.label for r in out]) > 0.9


def test_first_split_is_the_best_of_a_count_by_hand(spark):
    """The root of each tree, by counting the rows that the tree takes."""
    t = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 6 or i % 11 == 0)) for i in range(500)], "key long, x double, label int")
    model = ML.fit_cancellation(t, ["x"], trees=8, max_depth=1)
    ones = t.filter("label = 1").count()
    w = np.array([500 / (2 * (500 - ones)), 500 / (2 * ones)])
    rows = t.select("x", "label", F.xxhash64(*t.columns).alias("h")).collect()
    seeds = np.array([r.h for r in rows]).view(np.uint64)
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    times = np.concatenate([FR._draws(seeds, k, int(np.random.default_rng(42).integers(2**63))) for k in range(2)])
    part = lambda m, take: np.square(s := np.array([(take * m * (y == c)).sum() for c in (0, 1)]) * w).sum() / s.sum()
    for tree, take in enumerate(times):
        gains = {c: part(x <= c, take) + part(x > c, take) for c in range(9)}
        assert model.feature[tree, 0] == 0 and model.cut[tree, 0] == max(gains, key=gains.get)
        right = np.array([(take * (x > model.cut[tree, 0]) * (y == c)).sum() for c in (0, 1)]) * w
        assert model.value[tree, 2] == pytest.approx(right[1] / right.sum())


def test_rows_are_written_once_without_their_draws(spark, tmp_dir):
    """What a fit keeps of a row does not grow with the trees (MLlib's forest
    caches a count for every row and tree)."""
    t = _train(spark, 40000)
    columns = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("a", "b", "c")}
    edges = L.quantile_edges(L.value_counts(t, list(columns)), FR.BINS, FR.FEW)
    values = sorted(r.a for r in t.filter("a is not null").select("a").collect())
    assert edges["a"][15] == values[len(values) // 2 - 1] and edges["b"] == [0.0, 1.0, 2.0] and len(edges["a"]) == 31
    rows = FR._ranges(t, columns, "label", [np.array(edges[c]) for c in columns], 40000)
    assert rows.count() == 40000 and rows.agg(F.max(F.length("bins"))).first()[0] == 3
    times = FR._draws(np.arange(200000, dtype=np.uint64), 3, 5)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02
    ML.fit_cancellation(t, ["a", "b", "c"], trees=30, max_depth=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_and_other_labels(spark, label):
    t = spark.createDataFrame([(float(i), label) for i in range(30)], "x double, label int")
    model = ML.fit_cancellation(t, ["x"], trees=3, max_depth=2)
    assert {r.score for r in ML.score(model, t, []).collect()} == {float(label)}
    with pytest.raises(ValueError, match="two_classes"):
        ML.fit_cancellation(t.withColumn("label", F.lit(2)), ["x"], trees=3)
