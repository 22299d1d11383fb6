"""Nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import math

import pytest

import odd
from fleetcast.llm import byte_bpe, katz, language_id, licences, ngram_join, packing, piece_bpe, quality_qda, quality_rules
from fleetcast.llm.common import fold

RUN = {
    "byte_bpe": lambda spark, d: byte_bpe.round_trip(d),
    "byte_bpe_encode_decode": lambda spark, d: byte_bpe.decode(byte_bpe.encode(d)),
    "piece_bpe": lambda spark, d: piece_bpe.round_trip(d),
    "piece_bpe_encode_decode": lambda spark, d: piece_bpe.decode(piece_bpe.encode(d)),
    "ngram_join": lambda spark, d: ngram_join.join(d),
    "language_id": lambda spark, d: language_id.language_id(d),
    "packing": lambda spark, d: packing.pack(d),
    "licences": lambda spark, d: licences.scan(d),
    "quality_qda": lambda spark, d: quality_qda.quality_classifier(d, odd.labels(spark)),
    "quality_rules": lambda spark, d: quality_rules.quality_rules(d),
    "katz": lambda spark, d: katz.scores(d, fold("doc_id", 10) == 0),
}
ROWS = len(odd.TEXTS) + 4


@pytest.mark.parametrize("name", sorted(RUN))
def test_odd_rows_each_give_their_result(spark, name):
    rows = RUN[name](spark, odd.docs(spark)).collect()
    if name == "packing":
        rows = [r for r in rows if r.start == 0]
    assert len(rows) == ROWS
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 6 for r in rows) == 2
    for r in rows:
        for k, v in r.asDict().items():
            assert not (isinstance(v, float) and (math.isnan(v) or math.isinf(v))), (k, r)


@pytest.mark.parametrize("name", sorted(RUN))
def test_empty_table_gives_empty_result(spark, name):
    full, none = RUN[name](spark, odd.docs(spark)), RUN[name](spark, odd.empty(spark))
    assert none.count() == 0 and none.columns == full.columns


@pytest.mark.parametrize("name", sorted(set(RUN) - {"packing"}))
def test_repeated_rows_agree(spark, name):
    rows = [r for r in RUN[name](spark, odd.docs(spark)).collect() if r.doc_id == 6]
    own = {"row"}
    assert len(rows) == 2 and len({tuple(str(v) for k, v in r.asDict().items() if k not in own) for r in rows}) == 1


def test_keep_rows_keeps_all_columns(spark):
    d = odd.docs(spark)
    for kept in (quality_rules.keep_rows(d), quality_qda.keep_rows(d, odd.labels(spark)), ngram_join.keep_one(d)):
        assert kept.columns == d.columns and 0 < kept.count() <= ROWS


def test_keep_one_keeps_one_of_each_group(spark):
    kept = ngram_join.keep_one(odd.docs(spark)).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    # 4 and 5 differ in case, 6 and 7 and the repeated 6 are copies, 11 and 12 are copies
    assert ids == [0, 1, 2, 3, 4, 6, 8, 9, 10, 11, 13, 14]
    assert sum(r.doc_id is None for r in kept) == 2
