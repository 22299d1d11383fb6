"""Byte-level BPE encoding and decoding with the tokenizers library.

The vocabulary is a rank file. A byte-level model needs its merges, which
follow from the ranks: the two parts of a token are what the merges of lower
rank leave of its bytes. Encoding runs over Arrow batches. Token offsets come
from the bytes: a token has as many bytes as its entry, and a running count of
code-point starts turns byte offsets into character offsets. Decoding looks up
the bytes of each id; characters that were split over tokens are whole again
once the bytes are joined, and bytes that belong to none become U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from fleetcast.llm.common import bounded_batches, table, text_bytes, tidy
from fleetcast.llm.pieces import Cut, Pieces, before, byte_alphabet, flatten, latin_letters, starts_cut
from fleetcast.llm.textstats import IS_START

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(raw: np.ndarray, at: np.ndarray) -> Cut:
    """Cuts before a single blank or line end between two visible characters:
    no match of the splitting pattern holds white space after something else,
    and a single blank or line end before a word starts a match of its own.

    Visible ASCII and characters led by the bytes C3 to DF and E4 to F4 hold no
    white space; around others nothing is cut."""
    visible = (raw > 0x20) & (raw < 0x7F)
    later = (raw >= 0x80) & (raw < 0xC0)
    two, three = before(raw), before(raw, 2)
    end = visible | later & ((two >= 0xC3) & (two < 0xE0) | (two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three < 0xF0))
    begin = visible | (raw >= 0xC3) & (raw < 0xE0) | (raw >= 0xE4)
    start = np.zeros(len(raw), bool)
    start[1:-1] = ((raw == 0x20) | (raw == 0x0A))[1:-1] & end[:-2] & begin[2:]
    inner = at[1:-1]
    start[np.maximum(inner[inner > 0] - 1, 0)] = False        # the last byte of a row: what follows is another text
    return starts_cut(raw, at, start)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last two parts of ``token`` before the merge that makes it."""
    parts, last = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, last), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= last:
            raise ValueError(f"no merges lead to token {last}")
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark's tasks already use the cores
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        ranks = read_ranks(path)
        sign = byte_alphabet()
        spell = lambda b: "".join([sign[x] for x in b])
        merges = [tuple(map(spell, merge_parts(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.own_pattern = pattern == public_tokenizers.PATTERN
        self.spell, self.model = spell, self.tokenizer.model
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.length_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            self.length_of[r] = len(t)
        self.ranks, self.sign = ranks, dict(enumerate(sign))
        self.marks = {x: self._whole([x])[0] for x in (".", ",", "\n")}
        self.pieces = Pieces(cut if self.own_pattern else lambda raw, at: starts_cut(raw, at, np.zeros(len(raw), bool)), self._learn)

    def _whole(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._simple(p.decode()) for p in pieces]
        hard = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(hard, self._whole([pieces[i].decode() for i in hard])):
            found[i] = ids
        return flatten(found)

    def _simple(self, piece: str) -> list[int] | None:
        """[line end] [blank] Latin letters [one . or ,]: each is a match, and
        a match that is a token needs no merges."""
        if not self.own_pattern:
            return None
        head, tail, core = [], [], piece
        if core[:1] == "\n":
            head, core = self.marks["\n"], core[1:]
        if core[-1:] in (".", ","):
            core, tail = core[:-1], self.marks[core[-1]]
        word = core[1:] if core[:1] == " " and not head else core
        if not word or not latin_letters(word):
            return None
        raw = core.encode()
        token = self.ranks.get(raw)
        if token is not None:
            return [*head, token, *tail]
        return [*head, *[t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.sign))], *tail]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none for null or empty."""
        return self.pieces.encode(pa.array([text], pa.string()))[0].tolist()

    def offsets(self, text: str | None, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last. A token
        that ends inside a character reaches over that character."""
        starts = IS_START[np.frombuffer((text or "").encode(), np.uint8)]
        so_far = np.concatenate(([0], np.cumsum(starts)))
        end = np.cumsum(self.length_of[ids]) if len(ids) else np.zeros(0, np.int64)
        begin = end - self.length_of[ids] if len(ids) else end
        inside = ~starts[begin] if len(ids) else np.zeros(0, bool)
        return so_far[begin] - inside, so_far[end]

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@cache
def codec(path: str) -> ByteBpe:
    """One per worker and vocabulary, with the pieces it remembers. A file
    added by ``spark.sparkContext.addFile`` is found by its name."""
    return ByteBpe(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``key``, ``ids``, ``char_start`` and ``char_end`` (arrays) of each row.

    Null and empty texts have no ids. Repeated rows and null keys each give
    their row; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids, first, last = [], [], []
            column = batch.column(batch.schema.get_field_index(text))
            flat, at = bpe.pieces.encode(column)
            for t, a, b in zip(column.to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids.append(flat[a:b])
                begin, end = bpe.offsets(t, flat[a:b])
                first.append(begin)
                last.append(end)
            of = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, of) for x in (ids, first, last))],
                                             names=[key, "ids", "char_start", "char_end"])

    few = docs.select(key, text)
    kind = few.schema[key].dataType.simpleString()
    return few.mapInArrow(run, f"`{key}` {kind}, ids array<int>, char_start array<int>, char_end array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``key``, ``bytes`` (binary) and ``text`` of each row's ``ids``. Null or
    empty ids give empty bytes; an id outside the vocabulary is an error."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            raw = [bpe.decode_bytes(x or ()) for x in _texts(batch, "ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())],
                names=[key, "bytes", "text"])

    few = encoded.select(key, "ids")
    return few.mapInArrow(run, f"`{key}` {few.schema[key].dataType.simpleString()}, bytes binary, text string")


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """Digests of what ``encode`` and then ``decode`` give, in one pass, so
    that ids and bytes need not leave the worker: ``key``, ``n_tokens``,
    ``ids_sha256`` (of the decimal ids joined by one blank), ``decoded_sha256``
    (of the decoded bytes), ``last_char_end`` and ``lossless``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = codec(path), hashlib.sha256
        decimal = [str(i) for i in range(len(bpe.length_of))]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            raw, at = text_bytes(column)
            buffer, rows = raw.tobytes(), []
            chars = np.concatenate(([0], np.cumsum(IS_START[raw])))
            flat, of = bpe.pieces.encode(column)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                ids = flat[of[i]:of[i + 1]].tolist()
                back = bpe.decode_bytes(ids)
                rows.append((len(ids), sha(" ".join([decimal[i] for i in ids]).encode()).hexdigest(),
                             sha(back).hexdigest(), int(chars[a + len(back)] - chars[a]) if a + len(back) <= b else -1,
                             back == buffer[a:b]))
            cells = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cells, kinds)],
                                             names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "last_char_end", "lossless"])

    few = docs.select(key, text)
    kind = few.schema[key].dataType.simpleString()
    return few.mapInArrow(tidy(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, "
                               "last_char_end long, lossless boolean")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
