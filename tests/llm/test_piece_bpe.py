"""Merge-type SentencePiece encoding against the library."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL
from fleetcast.llm import piece_bpe

STRANGE = st.text(alphabet="aabAZ  \n\n\t.,-_0123'strELLthingé▁ßÉñµªº÷漢字́‍\U0001F642\x85\xa0 　<s></s>\x00", max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(STRANGE)
def test_ids_and_text_equal_the_librarys(library, text):
    bpe = piece_bpe.codec(piece_bpe.VOCABULARY)
    ids = bpe.encode(text)
    assert ids == library.encode(text)
    assert bpe.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" abcdehinorstéü.,", min_size=1, max_size=31))
def test_heap_and_matrix_agree(text):
    bpe = piece_bpe.codec(piece_bpe.VOCABULARY)
    text = text.replace(" ", "") + " "                       # one piece of text, but for the last blank
    symbol = np.append(bpe.of_char[[ord(c) for c in text]], -1)[None, :].astype(np.int32)
    row = bpe.by_matrix(symbol)
    assert row[row >= 0].tolist() == bpe.by_heap(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31_999), max_size=12))
def test_any_ids_decode_as_by_the_library(library, ids):
    assert piece_bpe.codec(piece_bpe.VOCABULARY).decode(ids) == library.decode(ids)


def test_long_runs_and_ties(library):
    bpe = piece_bpe.codec(piece_bpe.VOCABULARY)
    for text in (" " * 1000, "a" * 999, "x" + " " * 37 + "y", "=" * 100, "\n" * 50, "漢" * 40, "ab" * 500 + "." * 70):
        assert bpe.encode(text) == library.encode(text)


def test_pieces_survive_a_full_memory(library):
    bpe = piece_bpe.PieceBpe()
    bpe.pieces.kept = 5
    for i in range(30):
        text = " ".join(f"word{j} again again w{j * i}" for j in range(i))
        assert bpe.encode(text) == library.encode(text)
        assert len(bpe.pieces.known) <= 5 + 4 * i


def test_a_wrong_agenda_is_found_out():
    bpe = piece_bpe.PieceBpe()
    bpe.rank = np.where(bpe.rank < piece_bpe.NEVER, bpe.rank.max() - bpe.rank, bpe.rank)
    with pytest.raises(RuntimeError, match="the library gives"):
        bpe.encode("international understanding")


def test_documents(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = piece_bpe.op11_piece_bpe(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_frames(spark, library):
    d = spark.createDataFrame([(1, "né 漢字 x"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in piece_bpe.encode(d).collect()}
    assert rows == {1: library.encode("né 漢字 x"), 2: [], 3: []}
    assert {r.doc_id: r.text for r in piece_bpe.decode(piece_bpe.encode(d)).collect()} == {1: "né 漢字 x", 2: "", 3: ""}
