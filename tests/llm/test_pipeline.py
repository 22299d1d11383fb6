"""The pipeline against brute-force versions of its stages."""

import numpy as np
import pyarrow as pa
import zstandard

import corpus_pipeline
import odd
from conftest import SMALL
from fleetcast.llm import quality_qda, quality_rules
from test_joins import brute_components
from test_textstats import brute


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id: r for r in docs.collect()}
    compressor = zstandard.ZstdCompressor(level=3)
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test-stage")
        frames[name] = docs
    ids = lambda name: {r.doc_id for r in frames[name].select("doc_id").collect()}

    def good(text):
        b = brute(text)
        return b[0] >= 10 and 100 * b[4] <= 20 * b[0] and quality_rules.compression(text.encode(), compressor)[3]

    kept = {i: r for i, r in kept.items() if good(r.text)}
    assert ids("quality rules") == set(kept)

    import zlib
    order = sorted(kept)
    x = quality_qda.features(pa.array([kept[i].text for i in order]))
    n, first, second = np.zeros(2), np.zeros((2, x.shape[1])), np.zeros((2, x.shape[1], x.shape[1]))
    for c in (0, 1):
        rows = x[[labels.get(i) == c and zlib.crc32(str(i).encode()) % 5 != 0 for i in order]]
        n[c], first[c], second[c] = len(rows), rows.sum(0), rows.T @ rows
    score = quality_qda.model_from_sums(n, first, second).score(x)
    kept = {i: kept[i] for i, s in zip(order, score) if s >= 0.3}
    assert ids("quality classifier") == set(kept)

    component = brute_components({i: r.text for i, r in kept.items()}, 5, 80)
    kept = {i: r for i, r in kept.items() if component[i][1] == i}
    assert ids("near copies") == set(kept)
    assert frames["near copies"].columns == frames["quality rules"].columns

    pieces = frames["packing"].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in pieces} == set(kept) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_run_equals_its_stages(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.select("doc_id").distinct().count() > 50 and "sequence_id" in found.columns


def test_odd_documents_pass_through(spark):
    docs = odd.docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == odd.docs(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SMALL).count() == 0
