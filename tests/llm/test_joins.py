import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from conftest import MEDIUM, SMALL
from fleetcast.llm import licences, ngram_join, topk, warc
from fleetcast.llm.components import components
from fleetcast.llm.queries import ORACLE, QUERIES

SMALL_LETTERS = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    assert compare(QUERIES[name](spark, MEDIUM), duck(MEDIUM), ORACLE[name]) == []


# -- near copies --------------------------------------------------------------

def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(SMALL_LETTERS).split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def planted(seed=5):
    """Chains and clouds of near copies, a passage that all share, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(12, 150))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.4 else base
    texts += [" ".join(passage + [word() for _ in range(rng.randint(1, 60))]) for _ in range(60)]
    texts += [" ".join(passage), " ".join(passage[:59]), "a b", "A B", "a", "", None, "b a", "x y z"]
    return dict(enumerate(texts))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (3, 50)])
def test_planted_components(spark, width, percent):
    texts = planted()
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(d, width=width, percent=percent).collect()}
    assert found == brute_components(texts, width, percent)


def test_join_of_many_input_partitions(spark):
    texts = planted()
    rows = spark.sparkContext.parallelize([(i, texts[i % len(texts)]) for i in range(300)], 300)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.join(d).collect()
    assert len({r.row for r in found}) == 300
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components({i: texts[i % len(texts)] for i in range(300)}, 3, 90)


def test_row_numbers_fit_and_are_checked():
    import fleetcast.llm.chunks as C
    at = lambda partition, chunk: C.Chunk((partition << 32) + chunk, [], None, np.zeros(4, np.int64), None, None)
    numbers = [n for p in (0, 127, 128, (1 << 23) - 1) for c in (0, 1, (1 << 16) - 1) for n in ngram_join.row_numbers(at(p, c))]
    assert len(set(numbers)) == 36 and 0 <= min(numbers) and max(numbers) < 1 << 63
    for p, c in ((1 << 23, 0), (0, 1 << 16)):
        with pytest.raises(ValueError):
            ngram_join.row_numbers(at(p, c))


def test_join_of_documents_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op2_ngram_join(spark, SMALL).collect()}
    assert found == brute_components(texts, 3, 90)


def test_no_pairs_within_a_bucket_of_copies(spark):
    """Three hundred near copies of one text: far fewer comparisons than pairs."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    rows = ngram_join.document_rows(d, "text", "doc_id", 3, 90)
    made = []
    old = ngram_join.verify
    try:
        ngram_join.verify = lambda pairs, *a: (made.append(pairs.count()), old(pairs, *a))[1]
        links = ngram_join.find_links(rows, 90)
        assert components(links).select("label").distinct().count() == 1
    finally:
        ngram_join.verify = old
    assert sum(made) < 6 * 300


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += [(5, 5), (None, 3)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, **{i: 200 for i in range(200, 209)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- licences -----------------------------------------------------------------

def test_known_licences_at_any_wrap(spark):
    import textwrap
    from fleetcast.llm.licence_texts import KNOWN
    heads = ["", "Copyright (c) 2020 A. Smith, B Inc. All rights reserved.\n\n", "Copyright The Some Authors\nAll rights reserved.\n",
             "(c) 2019-2021 A\nCopyright (C) 2022 by B <b@x.org>\n"]
    texts = [(i, h + "\n".join(textwrap.wrap(t, w, break_long_words=False))) for i, t in KNOWN for w in (*range(40, 100, 3), 10000) for h in heads]
    texts += [(i, "Copyright (c) 2020 A. " + t) for i, t in KNOWN]
    # the usual wrap of the ISC text
    isc = next(t for i, t in KNOWN if i == "ISC")
    texts.append(("ISC", isc.replace("the above copyright", "the above\ncopyright")))
    d = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in licences.scan(d).collect()}
    assert [(k, texts[k]) for k in found if found[k] != texts[k][0]][:3] == []


def test_long_licences_at_any_wrap(spark):
    import textwrap
    from fleetcast.llm.licence_texts import LONG
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {i for i, _ in LONG}
    texts = LONG + [(i, "\n\n".join("\n".join(textwrap.wrap(p, w, break_long_words=False)) for p in t.split("\n\n")))
                    for i, t in LONG if "opyright (C)" not in t for w in (50, 72, 79)]
    d = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in licences.scan(d).collect()}
    assert [(k, texts[k][0]) for k in found if found[k] != texts[k][0]] == []


def test_only_the_notice_of_a_line_goes(spark):
    texts = ["the above\ncopyright notice stays", "copyrighted works stay", "Copyright\nholders stay", "Copyright 2020 A. B. Holder Inc. Gone",
             "Copyright 2020 The Holder. These words stay", "All rights reserved. Words", "copyright " + "-" * 100000 + " x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.t for r in d.orderBy("doc_id").select(licences.whole(licences.normal_lines(F.col("text"))).alias("t")).collect()]
    assert found == ["the above copyright notice stays", "copyrighted works stay", "copyright owners stay", "", "these words stay", "words", ""]


def test_licence_variants(spark):
    from fleetcast.llm.licence_texts import _MIT
    texts = ["Copyright (c) 2021 Somebody\n\n" + _MIT.upper(), _MIT.replace(",", " ;"), "© 2020 X\n" + _MIT.replace("sublicense", "sub-license"),
             _MIT + " and more", "words\nreleased under the mit license\nLicensed under CC BY-NC 4.0\nLicensed under CC BY-NC 4.0.",
             "Copyright 2020 only", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licences.scan(d).collect()}
    assert [found[i].license_id for i in range(8)] == ["MIT"] * 3 + [None] * 5
    assert found[4].line_licenses == "CC-BY-NC-4.0 notice,MIT notice" and found[4].n_license_lines == 3
    assert found[5].n_license_lines == found[6].n_license_lines == found[7].n_license_lines == 0


def test_known_licences_are_bounded(spark):
    with pytest.raises(ValueError):
        licences.known_digests(spark, [("x", "y")] * (licences.MOST_KNOWN + 1))


# -- search -------------------------------------------------------------------

def brute_top(x, ids, qx, qids, k):
    out = {}
    for q, i in zip(qx, qids):
        s = [(-int(q @ v), int(j)) for v, j in zip(x, ids) if j != i]
        out[int(i)] = [(j, -t) for t, j in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("spread, share", [(4, 0.6), (400, 1.01)])
def test_trees_match_brute_force_and_prune(spread, share):
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (25, 12))
    x = (centres[rng.integers(0, 25, 3000)] + rng.integers(-spread, spread + 1, (3000, 12))).astype(float)
    x[:400] = x[0]                                        # many equal vectors: ties
    ids = rng.permutation(3000)
    tree, of = topk.CoverTree(x), topk.CoverTree(x[::20], topk.QUERY_LEAF)
    assert sorted(tree.order) == list(range(3000))
    for node in range(len(tree.centre)):                  # covering radii hold
        below = tree.order[tree.lo[node]:tree.hi[node]]
        assert np.sqrt(((x[below] - x[tree.centre[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-6
    s = topk.Search(of, ids[::20], tree, ids, 5)
    want = brute_top(x, ids, x[::20], ids[::20], 5)
    for i, best, score in zip(ids[::20], s.best, s.score):
        assert [(int(a), int(b)) for a, b in zip(best, score)] == want[int(i)]
    assert s.points < share * 150 * 3000


def test_search_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 0.1, 8).astype("float32")]) for i in range(700)]
    rows[5] = (5, rows[0][1])
    rows += [(1000, None), (1050, [0.1, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, []), (None, [0.5] * 8), (1250, [0.5, 0.5]), (1300, [0.25, -0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    found = {}
    for r in topk.top_k(d, d.filter("vec_id % 50 = 0"), block=64, query_block=4).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = [(i, np.floor(256 * np.array(v, float))) for i, v in rows[:700]]
    want = brute_top([v for _, v in good], [i for i, _ in good], [v for i, v in good if i % 50 == 0], [i for i, _ in good if i % 50 == 0], 5)
    want[1250], want[1300] = [(1300, 128 * 64 - 128 * 128)], [(1250, 128 * 64 - 128 * 128)]
    assert found == want
    assert topk.top_k(d.limit(0), d.limit(0)).count() == 0
    assert topk.top_k(d, d.limit(0)).count() == 0


# -- archives -----------------------------------------------------------------


def test_large_vectors_take_part_exactly(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * (1e13 if i % 3 == 0 else 1e9 if i % 3 == 1 else 1)).tolist()) for i in range(60)]
    rows += [(60, [1e13, 1e13, 0.0, 0.0]), (61, [1e13, 1e13, 0.0, 2.0 ** -8]), (62, [1e307] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i < 62}
    clip = lambda s: max(min(s, 2 ** 63 - 1), -2 ** 63)
    expected = []
    for q in range(0, 62, 10):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5]
        expected += [(q, r, i, clip(-s)) for r, (s, i) in enumerate(scored, 1)]
    for block in (16, 4096):
        found = topk.top_k(d, d.filter("vec_id % 10 = 0"), block=block, query_block=4).collect()
        assert sorted(map(tuple, found)) == sorted(expected)


def test_revisits_resolve(spark):
    long, other = "x" * 999 + "é", "<p>" + "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30
    rows = [(1, "http://a", long), (2, None, long), (7, "http://c\r\nEvil: 1", long), (3, "d", other), (4, "d", other), (5, "e", "short"),
            (6, "e", "short"), (8, "f", None), (9, "g", ""), (None, "h", long), (10, "i", "y" * 1000), (10, "i", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    first, second = warc.deduplicate(pages)
    found = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to)
                   for r in warc.index_pages(spark, second).filter("page_id is null or page_id <> 10").collect())
    assert found == [(-1, 1001, "revisit", 7), (1, 1001, "revisit", 7), (2, 1001, "revisit", 7), (3, len(other), "revisit", 4),
                     (4, len(other), "response", None), (5, 5, "response", None), (6, 5, "response", None), (7, 1001, "response", None),
                     (8, 0, "response", None), (9, 0, "response", None)]
    tens = [(r.record_type, r.refers_to) for r in warc.index_pages(spark, second).filter("page_id = 10").collect()]
    assert sorted(tens, key=str) == [("response", None), ("revisit", 10)]
    back = {r.page_id: r for r in warc.read_archives(spark, first).collect()}
    assert bytes(back["3"].payload).decode() == other and back["7"].url == "http://c%0D%0AEvil: 1" and back["2"].url is None
    assert all(r.payload is None for r in warc.read_archives(spark, second).filter("record_type = 'revisit'").collect())


def test_archives_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    pages = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(warc.pages_to_records(pages), "bounded", "2024-01-01T00:00:00Z")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).collect()
    assert len(files) > 5 and sum(len(list(warc.parse(f.content))) for f in files) == 40


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.index_pages(spark, warc.deduplicate(pages)[1]).count() == 0
