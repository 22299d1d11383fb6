import collections
import math
import zlib

import numpy as np
import pytest

from conftest import MEDIUM, SMALL
from fleetcast.llm import katz, language_id, quality_qda


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    return {d.doc_id: d for d in docs}, labels


def test_language_accuracy_on_held_out_documents(spark, truth):
    rows = language_id.op3_language_id(spark, MEDIUM).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[0][r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"),
                                                       ("le chat et le chien", "fr"), ("12 34 !?", "en"), (None, "de"), ("", None)])]
    d = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.language_id(d).collect()}
    assert [found[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and found[3].score == 0
    assert found[1].lang_pred in ("en", "de", "fr")


def test_language_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_id.fit, "__defaults__", ("text", "lang", "doc_id", 40))     # so that a part is drawn
    d = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "lang")
    copies = d.filter("doc_id < 20").unionByName(d.filter("doc_id < 20"))
    d = d.unionByName(copies)
    one, other = ({(r.doc_id, r.lang_pred, r.score) for r in language_id.language_id(x).collect()} for x in (d.coalesce(1), d.repartition(7)))
    assert one == other and len(one) == 1000


def test_three_close_languages_vote():
    rng = np.random.default_rng(0)
    shares = np.vstack([rng.dirichlet(np.ones(50) + 5 * (np.arange(50) % 3 == k), 60) for k in range(3)])
    w, b = language_id.fit_pair(shares[:120], np.repeat([1.0, -1.0], 60))
    margin = shares[:120] @ w + b
    assert (margin[:60] > 0).mean() > 0.9 and (margin[60:] < 0).mean() > 0.9


def test_quality_accuracy_on_held_out_documents(spark, truth):
    rows = quality_qda.op6_quality_qda(spark, MEDIUM).collect()
    held = [(r, truth[1][r.doc_id]) for r in rows if r.held_out and truth[1].get(r.doc_id) is not None]
    assert len(rows) == len(truth[0])
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    good, bad = [r.score for r, q in held if q == 1], [r.score for r, q in held if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.98
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_density_difference_matches_a_direct_computation():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (300, 3)) @ rng.normal(0, 1, (3, 3)), rng.normal(1, 2, (500, 3))]
    n = np.array([300.0, 500.0])
    m = quality_qda.model_from_sums(n, np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    both = np.vstack(x)
    z, logs = (both - both.mean(0)) / both.std(0), []
    cov = [np.cov(((a - both.mean(0)) / both.std(0)).T, bias=True) for a in x]
    pooled = (300 * cov[0] + 500 * cov[1]) / 800
    for k in (0, 1):
        s = (1 - quality_qda.TO_POOLED) * cov[k] + quality_qda.TO_POOLED * pooled
        s = (1 - quality_qda.TO_DIAGONAL) * s + quality_qda.TO_DIAGONAL * np.diag(np.diag(s)) + quality_qda.RIDGE * np.eye(3)
        d = z - ((x[k] - both.mean(0)) / both.std(0)).mean(0)
        logs.append(math.log((n[k] + 1) / 802) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(m.score(both), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_one_class_gives_a_constant():
    m = quality_qda.model_from_sums(np.array([0.0, 3.0]), np.zeros((2, 2)), np.zeros((2, 2, 2)))
    assert m.score(np.zeros((2, 2))).tolist() == [0.8, 0.8]


# -- language model -----------------------------------------------------------

SMALL_LETTERS = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class BruteKatz:
    def __init__(self, texts):
        self.one, self.two, self.history = collections.Counter(), collections.Counter(), collections.Counter()
        for w in texts:
            self.one.update(w)
            self.history.update(["<s>", *w[:-1]])
            self.two.update(zip(["<s>", *w[:-1]], w))
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d1, self.d2 = self.discounts(self.one), self.discounts(self.two)
        scale = 1.0 if not self.n or any(c <= 5 for c in self.one.values()) else 1 - 0.5 / self.n
        self.p = {w: scale * self.d1.get(c, 1) * c / self.n for w, c in self.one.items()}
        self.unknown = 1 - sum(self.p.values())
        self.after = collections.defaultdict(list)
        for (h, w), c in self.two.items():
            self.after[h].append((w, c))

    def discounts(self, counter):
        n, out = collections.Counter(counter.values()), {}
        cut = 6 * n[6] / n[1] if n[1] else 1.0
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def weight(self, h):
        seen = sum(self.d2.get(c, 1) * c for _, c in self.after[h])
        c = self.history[h]
        f = (c - 0.5) / seen if seen > c - 0.5 else 1.0
        return (1 - f * seen / c) / (1 - sum(self.p[w] for w, _ in self.after[h])), f

    def prob(self, h, w):
        if not self.history[h]:
            return self.p.get(w, self.unknown)
        a, f = self.weight(h)
        c = self.two[h, w]
        return f * self.d2.get(c, 1) * c / self.history[h] if c else a * self.p.get(w, self.unknown)


def words(text):
    return (text or "").encode().translate(SMALL_LETTERS).split() + ["</s>"]


def test_katz_matches_brute_force_and_adds_up_to_one(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    model = BruteKatz([w for i, w in docs.items() if not held[i]])
    for h in ["<s>", *list(model.after)[:40]]:
        assert abs(sum(model.prob(h, w) for w in model.one) + model.prob(h, "never seen") - 1) < 1e-9
    for r in katz.op10_katz_scores(spark, SMALL).collect():
        w = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(w), model.n)
        assert r.n_known == sum(x in model.one for x in w)
        base = sum(math.log10((model.one[x] + 0.1) / (model.n + 0.1 * (model.v + 1))) for x in w)
        score = sum(math.log10(model.prob(h, x)) for h, x in zip(["<s>", *w[:-1]], w))
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6


def test_katz_over_many_slots_and_chunks(spark, monkeypatch):
    from fleetcast.llm import chunks
    from fleetcast.llm.common import fold
    d = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    want = {r.doc_id: r.score for r in katz.scores(d, fold("doc_id", 10) == 0).collect()}
    monkeypatch.setattr(chunks, "slots", lambda parts, tokens=0: 7)
    got = {r.doc_id: r.score for r in katz.scores(d, fold("doc_id", 10) == 0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_katz_frees_mass_where_nothing_is_discounted(spark):
    rows = [(i, "a b a b a b a b", False) for i in range(8)] + [(100, "c a", True), (101, None, True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    found = {r.doc_id: r for r in katz.scores(d, d["held"]).collect()}
    model = BruteKatz([words("a b a b a b a b")] * 8)
    for i, t in ((0, "a b a b a b a b"), (100, "c a"), (101, "")):
        w = words(t)
        want = sum(math.log10(model.prob(h, x)) for h, x in zip(["<s>", *w[:-1]], w))
        assert abs(found[i].score - want) < 1e-9


def test_katz_without_training_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    from pyspark.sql import functions as F
    for r in katz.scores(d, F.lit(True)).collect():
        assert r.score == 0 and r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0
