import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetcast.llm import quality_rules
from fleetcast.llm.common import text_bytes
from fleetcast.llm.textstats import base_stats, intern_words

import zstandard

WORD = "[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words, windows = re.findall(WORD, text), {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, len(covered)]


def stats(texts):
    raw, at = text_bytes(pa.array(texts, pa.string()))
    return [list(x) for x in zip(*(v.tolist() for v in base_stats(raw, at, *intern_words(raw, at)[:2]).values()))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\r\x0b\x1c#é漢|\x85", max_size=60)), max_size=6))
def test_base_counts_match_brute_force(texts):
    assert stats(texts) == [brute(t) for t in texts]


def test_windows_do_not_cross_rows():
    assert [r[4] for r in stats(["a b c d e", "a b c d e", "a b c d e a b c d e"])] == [0, 0, 10]


def test_chunks_cover_the_text():
    for n in (0, 1, 2047, 2048, 3000, 3072, 5000, 6144):
        raw = bytes(range(256)) * 24
        parts = quality_rules.chunks(raw[:n])
        assert b"".join(parts) == raw[:n]
        assert all(1024 <= len(p) < 3072 for p in parts) or n < 1024


def test_bands_reject_repetition_and_noise_and_keep_prose():
    import os
    import random
    c = zstandard.ZstdCompressor(level=3)
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(3000)).encode()
    noise = os.urandom(9000).hex().encode() + os.urandom(9000)
    verdict = lambda raw: quality_rules.compression(raw, c)[3]
    assert verdict(prose) and verdict(prose[:700]) and verdict(b"") and verdict(b"ok then")
    assert not verdict(b"the same sentence over and over. " * 100)
    assert not verdict(os.urandom(4000))
    assert not verdict(noise)
    assert not verdict(prose[:6000] + b"again and again. " * 400)


def test_rules_match_brute_force_on_documents(spark):
    from conftest import SMALL
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    c = zstandard.ZstdCompressor(level=3)
    for r in quality_rules.op8_quality_rules(spark, SMALL).collect():
        want = brute(docs[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed
        assert r.kept == (not failed and quality_rules.compression(docs[r.doc_id].encode(), c)[3])
