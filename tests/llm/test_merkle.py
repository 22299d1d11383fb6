"""The Merkle manifest against a direct construction."""

import hashlib
import zlib

import numpy as np
import pytest

import odd
from conftest import SMALL
from fleetcast.llm import merkle
from fleetcast.llm.numbering import numbered
from pyspark.sql import functions as F


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute_postorder(nodes):
    """Digests of the whole tree, children before their parent."""
    tree = levels(nodes)

    def walk(h, i):
        below = [x for k in (2 * i, 2 * i + 1) if h and k < len(tree[h - 1]) for x in walk(h - 1, k)]
        return [*below, (h, i, tree[h][i])]

    return walk(len(tree) - 1, 0)


def brute_steps(tree, i):
    out = []
    for level in tree[:-1]:
        k = i ^ 1
        out.append((None if k >= len(level) else level[k], i % 2))
        i //= 2
    return out


def brute_fold(leaf, steps):
    for other, right in steps:
        leaf = H(leaf) if other is None else H(other, leaf) if right else H(leaf, other)
    return leaf


def brute(rows, altered):
    """doc_id -> result, from (doc_id, source, lang, n_chars, text) rows with distinct ids."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in groups}
    crown = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = brute_steps(trees[g], i) + brute_steps(crown, k)
            shown = (*r[:3], r[3] + 1, r[4]) if altered(r) and r[3] is not None else r
            folded = brute_fold(leaf(shown), steps)
            out.append((r[0], leaf(r), trees[g][-1][0], crown[-1][0], H(*[s for s, _ in steps if s]), folded, folded == crown[-1][0]))
    return out


@pytest.mark.parametrize("n", [*range(1, 34), 63, 64, 65, 100])
def test_logs_are_in_postorder_and_places_are_closed_form(n):
    leaves = [H(str(i)) for i in range(n)]
    log, level = merkle.append_log(leaves, merkle.height(n))
    expected = brute_postorder(leaves)
    assert log == [d for _, _, d in expected] and level == [h for h, _, _ in expected]
    for at, (h, i, _) in enumerate(expected):
        assert merkle.place(h, i, n) == at
    tree = levels(leaves)
    for i, path in enumerate(merkle.steps(np.array(log, object), n, merkle.height(n))):
        assert [s for _, s in merkle.siblings(path)] == [s or "" for s, _ in brute_steps(tree, i)]
        assert merkle.fold(leaves[i], path) == tree[-1][0]


@pytest.mark.parametrize("bits", [1, 2, 3, 12])
def test_tiers_give_the_same_proofs_and_logs(spark, bits):
    rows = [(i * 3, f"s{i % 4}", [None, "en", "fr", "é", "z"][min(i % 9, 4)], None if i % 5 == 0 else i, None if i % 11 == 0 else "x" * (i % 7)) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    changed = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proofs, log, roots = merkle.manifest(docs, altered={"n_chars": changed}, bits=bits)
    assert sorted(map(tuple, merkle.verify(proofs).collect())) == sorted(brute(rows, lambda r: r[0] % 2 == 0))
    by_tree = {}
    for r in log.collect():
        by_tree.setdefault(r.tree, []).append((r.place, r.level, r.digest))
    sizes = {r.tree: (r["size"], r.digest) for r in roots.collect()}
    assert set(sizes) == set(by_tree) == {"", "=en", "=fr", "=é", "=z"}
    for tree, nodes in by_tree.items():
        nodes.sort()
        assert [n[0] for n in nodes] == list(range(len(nodes)))
        leaves = [d for _, h, d in nodes if h == 0]
        assert [(h, d) for _, h, d in nodes] == [(h, d) for h, _, d in brute_postorder(leaves)]
        assert sizes[tree] == (len(leaves), nodes[-1][2])


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*merkle.FIELDS)
    expected = brute([tuple(r) for r in docs.collect()], lambda r: zlib.crc32(str(r[0]).encode()) % 7 == 0)
    got = [tuple(r) for r in merkle.op12_merkle_manifest(spark, SMALL).collect()]
    assert sorted(got) == sorted(expected)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_odd_rows(spark):
    d = odd.docs(spark)
    rows = [tuple(r) for r in d.select(*merkle.FIELDS).collect()]
    proofs, _, _ = merkle.manifest(d, bits=2)
    got = merkle.verify(proofs).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, lambda r: False), key=key)
    assert all(r.verified for r in got)


def test_empty_table_and_one_row(spark):
    proofs, log, roots = merkle.manifest(odd.empty(spark))
    assert merkle.verify(proofs).count() == 0 and log.count() == 0 and roots.count() == 0
    proofs, _, _ = merkle.manifest(odd.docs(spark).filter("doc_id = 3"))
    r = merkle.verify(proofs).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H()


def test_one_key_with_most_rows_is_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("key"), F.lit("=a").alias("tree"), F.lit("d").alias("digest"))
    n = numbered(rows.repartition(16), ["key", "digest"])
    assert [r.pos for r in n.orderBy("pos").collect()] == list(range(3000))
    assert n.filter("key = 7").agg(F.min("pos"), F.max("pos")).first()[:] == (0 + n.filter("key < 7").count(), 1999 + n.filter("key < 7").count())
