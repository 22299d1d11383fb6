import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL
from fleetcast.llm import byte_bpe, packing

STRANGE = st.text(alphabet="aabAZ  \n\n\t.,-_0123'strELLéßÉñµªº÷漢字́‍\U0001F642\x85\xa0 　İ٣²½ⅷ\x1c𝒳", max_size=40)


@pytest.fixture(scope="module")
def reference_encoding():
    with open(byte_bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(STRANGE)
def test_ids_equal_tiktokens(reference_encoding, text):
    bpe = byte_bpe.codec(byte_bpe.VOCABULARY)
    ids = bpe.encode(text)
    assert ids == reference_encoding.encode_ordinary(text)
    assert bpe.decode(ids) == text
    first, last = bpe.offsets(text, ids)
    for i, a, b in zip(ids, first, last):              # a token's bytes are part of its characters
        assert bpe.bytes_of[i] in text[a:b].encode()
    assert len(ids) == 0 or last[-1] == len(text)


def test_split_characters():
    bpe = byte_bpe.codec(byte_bpe.VOCABULARY)
    ids = bpe.encode("漢")
    assert len(ids) > 1 and bpe.decode(ids[:1]) == "�" and bpe.decode(ids) == "漢"
    first, last = bpe.offsets("漢", ids)
    assert set(first) == {0} and set(last) == {1}


def test_round_trip_of_documents(spark, reference_encoding):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in byte_bpe.op1_byte_bpe(spark, SMALL).collect():
        ids = reference_encoding.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.lossless and r.last_char_end == len(docs[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_encode_and_decode_frames(spark):
    d = spark.createDataFrame([(1, "né 漢字 x"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in byte_bpe.encode(d).collect()}
    assert rows[2].ids == [] and rows[3].ids == [] and rows[1].char_end[-1] == 7
    back = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(d)).collect()}
    assert back[1].text == "né 漢字 x" and bytes(back[2].bytes) == b""


@settings(max_examples=300, deadline=None)
@given(STRANGE)
def test_word_ids_equal_the_tokenizers(text):
    words = packing.encoder(packing.VOCABULARY)
    assert words.encode(text) == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_word_is_learnt_once_whatever_its_case_and_marks():
    words = packing.WordBpe()
    learnt, learn = [], words.pieces.learn
    words.pieces.learn = lambda pieces: (learnt.extend(pieces), learn(pieces))[1]
    texts = ["word Word WORD word. (word), [word]!! word's", "Été été, ÉTÉ! 'été\tété\r\n", "1234 word12", "don't 'tis ''s it'll"]
    for text in texts:
        assert words.encode(text) == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert learnt.count(b"word") == learnt.count("été".encode()) == 1
    assert not [p for p in learnt if p != b"word" and b"word" in p.lower()]
    assert not [p for p in learnt if "été" in p.decode().lower() and p.decode() not in ("été", "'été")]
    assert {p for p in learnt if p.isdigit()} == {b"1", b"2", b"3", b"4"}


def test_a_file_with_another_pattern_is_asked_for_whole_texts(tmp_path):
    from tokenizers import Regex, Tokenizer, pre_tokenizers
    other = Tokenizer.from_file(packing.VOCABULARY)
    assert packing.WordBpe().own
    other.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"), "removed", invert=True),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    words = packing.WordBpe(str(tmp_path / "other.json"))
    assert not words.own
    for text in ("In 1999, 20 of Them.", "", "don't 12a", None):
        assert words.encode(text) == other.encode(text or "", add_special_tokens=False).ids


# Where letters compose with what follows, lower-casing first would give other ids
COMPOSING = st.text(alphabet="HhIiEeÉêÇçßÞ×÷ªºA1.'’<=>!sStrLl \t\r\x0b\x1c\x7f\u0331\u0307\u0301\u0338\u0345\u030a\u20e3ΣσǅİſK½²漢\xad\xa0", max_size=30)


@settings(max_examples=600, deadline=None)
@given(COMPOSING)
def test_word_ids_where_letters_compose(text):
    words = packing.encoder(packing.VOCABULARY)
    assert words.encode(text) == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_cuts_keep_to_their_rows():
    words = packing.WordBpe()
    texts = ["", "É", "H", "\u0331h", None, "'", "s", "a'", "tÉ", "\u0301", "", "É", "x\n"]
    for texts in (texts, texts[::-1], texts[:-1] + [None]):
        got = [ids.tolist() for ids in words.encode_rows(pa.array(texts, pa.string()))]
        assert got == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_added_tokens_in_a_text_are_the_files_own():
    from tokenizers import Tokenizer
    plain, words = Tokenizer.from_file(packing.VOCABULARY), packing.WordBpe()
    assert words.encode("a <|endoftext|> b") == [320, 49407, 321]
    for text in ("a<|startoftext|>b, c.", "<|endoftext|>\n\n<|endoftext|>x", "<|ENDOFTEXT|> y", "<|endoftext", "é<|endoftext|>\u0301 L"):
        assert words.encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_packing_of_documents(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(packing.VOCABULARY)
    rows = [r.asDict() for r in packing.op4_packing(spark, SMALL).collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    by_doc, by_sequence, padding, total = {}, {}, 0, 0
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {d.doc_id for d in docs}
    for d in docs:
        ids = np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        window = pieces[0]["window"]
        assert at <= window <= 4096
        padding, total = padding + window - at, total + at
    assert padding < 4096 * 8 and padding < 0.05 * total       # the last window of each task


def runs(lengths):
    return [packing.Run(i, np.arange(n, dtype="<u4")) for i, n in enumerate(lengths)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.integers(1, 7))
def test_packer_places_each_id_once(lengths, every):
    p = packing.Packer((8, 16, 32, 64), 256)
    for i, run in enumerate(runs(lengths)):
        p.put(run)
        if i % every == 0:
            p.pack()
    p.pack(last=True)
    seen, open_windows = {}, 0
    by = {}
    for run, start, length, sequence, offset, window in p.out:
        seen.setdefault(run.row, []).extend(range(start, start + length))
        by.setdefault(sequence, []).append((offset, length, window))
    assert {k: sorted(v) for k, v in seen.items()} == {i: list(range(n)) for i, n in enumerate(lengths)}
    for pieces in by.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        open_windows += at != pieces[0][2]
        assert at <= pieces[0][2]
    assert open_windows <= 1
    room = {}
    for sequence, group in enumerate(p.step_of):
        room[group] = room.get(group, 0) + by[sequence][0][2]
    assert all(v <= 256 for v in room.values())
