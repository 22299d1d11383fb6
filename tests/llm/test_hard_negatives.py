"""Hard negatives against scoring every pair with Python integers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetcast.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=10, positives=3, negatives=4, low=30, high=90):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if None not in (i, v, label) and len(v) and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for i, label, v in good:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            window = sorted((t, k) for t, k, other in scored if other != label and low * -s <= 100 * -t <= high * -s)
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, parts=3, **how):
    how = {"positives": 3, "negatives": 4, "bits": 4, "anchor_bits": 2, **how}
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, hn.mine(df, df.filter("vec_id % 10 = 0"), **how).collect()))


def vectors(seed, n=150, dim=20, labels=3, clusters=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    return [(i, (centres[i % clusters] + 0.4 * r.normal(size=dim)).tolist(), int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = vectors(seed)
    expected = brute(rows)
    assert len(expected) > 50 and mined(spark, rows) == expected


def test_other_windows_and_one_block(spark):
    rows = vectors(3)
    assert mined(spark, rows, bits=13, low=50, high=80) == brute(rows, low=50, high=80)


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.25, -0.5] if i % 3 else [0.25, 0.25, float(i % 2)], i % 4) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = vectors(4, 60)
    rows += rows[20:31] + [(20, rows[3][1], 0)] * 7 + [(33, rows[20][1], rows[20][2])] * 9
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(5, 80, dim=5)
    rows += [(None, [1.0] * 5, 1), (100, None, 1), (110, [1.0, None, 1.0, 1.0, 1.0], 1), (120, [1.0] * 5, None), (130, [float("nan")] * 5, 1),
             (140, [float("inf")] * 5, 2), (150, [], 1), (160, [0.0] * 5, 1), (161, [0.0] * 5, 1), (170, [-0.0, 1.0], 1), (171, [1.0, 1.0], 1),
             (172, [0.5, 0.5], 2), (180, [1e307] * 5, 1)]
    assert mined(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS tree", "2 AS pos", "3 AS block", "4 AS score", "5 AS v", "6 AS id")
    assert sorted(map(tuple, hn.mine(df, df.filter("vec_id % 10 = 0"), positives=3, negatives=4).collect())) == brute(rows)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(6)
    rows = vectors(6, 50, dim=4) + [(i, (1e13 * r.normal(size=4)).tolist(), i % 2) for i in range(50, 90)]
    expected = brute(rows)
    assert any(abs(x[4]) > 2 ** 63 for x in expected)
    clip = lambda s: max(min(s, 2 ** 63 - 1), -2 ** 63)
    assert mined(spark, rows) == sorted((*x[:4], clip(x[4]), clip(x[5])) for x in expected)


def test_empty_tables_and_no_partner(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(vectors(7, 30), SCHEMA)
    assert hn.mine(none, none).count() == 0 and hn.mine(some, none).count() == 0 and hn.mine(none, some).count() == 0
    assert mined(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)]) == []
    assert mined(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 70), st.integers(1, 40), st.integers(1, 6), st.sampled_from([-1, 0, 1, 30, 300, 3000]))
def test_join_gives_all_pairs_in_range(seed, n, dim, anchors, least):
    r = np.random.default_rng(seed)
    scale = np.exp(-np.arange(dim) / 5) * 40
    x, q = (np.rint(r.normal(size=(k, dim)) * scale) for k in (n, anchors))
    index = hn.Index(hn.Block(np.arange(n), np.zeros(n), x))
    low, high = [least * 10 + i for i in range(anchors)], [least * 20 + 500] * anchors
    got = sorted((int(a), int(b), int(s)) for rows, cols, score in index.pairs(q, low, high) for a, b, s in zip(rows, cols, score))
    full = x @ q.T
    assert got == [(a, b, int(full[a, b])) for a in range(n) for b in range(anchors) if low[b] <= full[a, b] <= high[b]]


def test_small_suffixes_are_left_out_of_the_index():
    x = np.zeros((10, 64))
    x[:, 0], x[:, 40] = 100, 1
    index = hn.Index(hn.Block(np.arange(10), np.zeros(10), x))
    touched = []
    index._complete, whole = lambda *a: touched.append(a[4]) or whole(*a), index._complete
    assert sum(len(p[0]) for p in index.pairs(x[:2], [9000, 9000], [20000, 20000])) == 20
    assert touched == [hn.CHUNK]                              # one chunk was accumulated
