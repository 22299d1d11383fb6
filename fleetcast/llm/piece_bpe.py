"""Merge-type SentencePiece encoding and decoding.

The model file gives the pieces and their scores. A text is a blank followed
by the text, blanks spelt as U+2581, and its symbols are single characters at
first. An agenda holds every adjacent pair whose joint is a piece; the pair of
the highest score is taken off (the leftmost of equal ones), joined, and the
pairs with its two neighbours are entered. A character that is no piece
becomes the byte pieces of its UTF-8 form.

No piece holds a blank after another character, or a line end, so texts are
cut there, and each distinct piece of text runs through an agenda once. The
agendas of all new pieces of an Arrow batch advance together: a row of pair
ranks for each. Long ones, and those with byte pieces, have a heap instead.
What either gives is compared with the sentencepiece library, piece by piece,
before it is used.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from fleetcast.llm.common import bounded_batches, table, text_bytes, tidy
from fleetcast.llm.pieces import Cut, Pieces, before, flatten, ranges, starts_cut

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
UNKNOWN_SURFACE = " ⁇ "          # what the library decodes the unknown id to
WIDTHS = (8, 16, 32)                  # symbols of a piece of text in a row of an agenda matrix
NEVER = np.int32(2 ** 31 - 1)         # rank of a pair that is no piece
GONE = -2                             # a symbol that was joined to its left neighbour


def cut(raw: np.ndarray, at: np.ndarray) -> Cut:
    """Cuts before each run of blanks and around each line end."""
    last = before(raw)
    return starts_cut(raw, at, (raw == 0x20) & (last != 0x20) | (raw == 0x0A) | (last == 0x0A))


class PairTable:
    """Open addressing table from a pair of ids to the piece that they make."""

    def __init__(self, left: np.ndarray, right: np.ndarray, piece: np.ndarray, n: int):
        self.n = n
        self.bits = max(int(len(piece) * 8).bit_length(), 4)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, n, np.int32)
        keys = left.astype(np.int64) * n + right
        place, todo, self.probes = self._place(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[place[todo]] < 0]
            self.keys[place[free]] = keys[free]                      # the last of equal places wins
            done = self.keys[place[todo]] == keys[todo]
            self.values[place[todo[done]]] = piece[todo[done]]
            todo = todo[~done]
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair; ``n`` where there is none or an id is negative."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n + right, -1)
        place = self._place(keys)
        out = np.where(self.keys[place] == keys, self.values[place], self.n)
        open_ = np.flatnonzero((self.keys[place] != keys) & (self.keys[place] >= 0) & (keys >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            p = (place[open_] + step) & ((1 << self.bits) - 1)
            hit = self.keys[p] == keys[open_]
            out[open_[hit]] = self.values[p[hit]]
            open_ = open_[~hit & (self.keys[p] >= 0)]
        return out.reshape(shape)


class PieceBpe:
    """Encoder and decoder of one merge-type model with byte pieces. Models
    whose normaliser changes texts are refused by the library check."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.id_of = {names[i]: i for i in normal}
        several = [p for p in self.id_of if len(p) > 1]
        if (len(self.byte_id) != 256 or any(sp.is_unused(i) for i in range(n))
                or any("\n" in p or BLANK in p.lstrip(BLANK) or any(c not in self.id_of for c in p) for p in several)):
            raise ValueError("the model has no byte pieces, unused pieces, or pieces across words")
        self.rank = np.full(n + 1, NEVER, np.int32)          # equal scores have equal ranks
        self.rank[normal] = np.unique(-np.array([sp.get_score(i) for i in normal]), return_inverse=True)[1]
        splits = [(self.id_of[p[:k]], self.id_of[p[k:]], self.id_of[p]) for p in several for k in range(1, len(p))
                  if p[:k] in self.id_of and p[k:] in self.id_of]
        self.joint = PairTable(*np.array(splits, np.int64).reshape(-1, 3).T, n)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[0x20] = self.id_of.get(BLANK, -1)
        surface = {i: names[i].replace(BLANK, " ").encode() for i in normal}
        surface |= {i: bytes([b]) for b, i in self.byte_id.items()}
        surface |= {i: UNKNOWN_SURFACE.encode() for i in range(n) if sp.is_unknown(i)}
        self.surface = [surface.get(i, b"") for i in range(n)]
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte_id.values())] = True
        self.blank_first = {i for p, i in self.id_of.items() if p[0] == BLANK}
        self.pieces = Pieces(cut, self._learn)

    # Encoding

    def by_heap(self, text: str) -> list[int]:
        """The ids of a piece of text, by an agenda of its own."""
        chars = text.replace(" ", BLANK)
        symbol = [self.id_of.get(c, -1) for c in chars]
        left, right = list(range(-1, len(symbol) - 1)), list(range(1, len(symbol) + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            if i >= 0 and j < len(symbol) and symbol[i] >= 0 and symbol[j] >= 0:
                piece = pair.get((symbol[i], symbol[j]))
                if piece is None:
                    piece = pair[symbol[i], symbol[j]] = int(self.joint(np.array([symbol[i]]), np.array([symbol[j]]))[0])
                if piece < self.n:
                    heapq.heappush(agenda, (int(self.rank[piece]), i, symbol[i], symbol[j], piece))

        pair: dict[tuple[int, int], int] = {}
        for i in range(len(symbol) - 1):
            enter(i, i + 1)
        while agenda:
            _, i, a, b, piece = heapq.heappop(agenda)
            j = right[i]
            if symbol[i] != a or j >= len(symbol) or symbol[j] != b:
                continue                                     # a side was joined to another since
            symbol[i], symbol[j] = piece, GONE
            right[i] = right[j]
            if right[j] < len(symbol):
                left[right[j]] = i
            enter(left[i], i)
            enter(i, right[i])
        return [x for c, s in zip(chars, symbol) if s != GONE for x in ([s] if s >= 0 else [self.byte_id[b] for b in c.encode()])]

    def by_matrix(self, symbol: np.ndarray) -> np.ndarray:
        """The agendas of many pieces of text, a row each: ``symbol`` has their
        symbols, -1 behind the last and in one more column. Joined symbols are
        GONE in the result."""
        n, wide = symbol.shape
        last = wide - 1
        right, left = np.tile(np.arange(1, wide + 1), (n, 1)), np.tile(np.arange(-1, last), (n, 1))
        piece = np.full((n, wide), self.n, np.int32)
        piece[:, :last] = self.joint(symbol[:, :-1], symbol[:, 1:])
        rank, rows = self.rank[piece], np.arange(n)
        while True:
            best = rank[rows].argmin(1)                      # the leftmost of the best
            some = rank[rows, best] < NEVER
            rows, i = rows[some], best[some]
            if not len(rows):
                return symbol
            j = right[rows, i]
            k = right[rows, j]
            symbol[rows, i], symbol[rows, j] = piece[rows, i], GONE
            right[rows, i], left[rows, k] = k, i
            rank[rows, j] = NEVER
            for a, b in ((i, k), (left[rows, i], i)):        # column -1 is the last one, which has no symbol
                piece[rows, a] = self.joint(symbol[rows, a], symbol[rows, b])
                rank[rows, a] = self.rank[piece[rows, a]]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(size)))
        symbol = self.of_char[points]
        plain = np.add.reduceat(symbol < 0, at[:-1]) == 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []         # pieces, their ids, how many of each
        for low, high in zip((0, *WIDTHS), WIDTHS):
            some = np.flatnonzero(plain & (size > low) & (size <= high))
            rows = np.full((len(some), high + 1), -1, np.int32)
            rows[np.repeat(np.arange(len(some)), size[some]), ranges(np.zeros(len(some), np.int64), size[some])] = symbol[ranges(at[some], size[some])]
            rows = self.by_matrix(rows)
            found.append((some, rows[rows >= 0], (rows >= 0).sum(1)))
        some = np.flatnonzero(~plain | (size > WIDTHS[-1]))
        found.append((some, *flatten([self.by_heap(texts[i]) for i in some])))
        count = np.zeros(len(texts), np.int64)
        for some, _, counts in found:
            count[some] = counts
        start, out = np.cumsum(count) - count, np.zeros(count.sum(), np.int32)
        for some, ids, counts in found:
            out[ranges(start[some], counts)] = ids
        self._compare(texts, out, count)
        return out, count

    def _compare(self, texts: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        """The library's ids of each text, behind a line end that keeps its
        leading blank off, are these."""
        ours = np.split(ids, np.cumsum(count)[:-1])
        for text, mine, theirs in zip(texts, ours, self.library.encode(["\n" + t for t in texts], num_threads=1)):
            if mine.tolist() != theirs[2:]:
                raise RuntimeError(f"{text!r}: the library gives {theirs[2:]}, the agenda {mine.tolist()}")

    def encode_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the n + 1 offsets of the rows in them."""
        column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), BLANK, " ")
        blank = pc.if_else(pc.equal(pc.binary_length(column), 0), "", " ").cast(pa.large_string())
        return self.pieces.encode(pc.binary_join_element_wise(blank, column, pa.scalar("", pa.large_string())))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none for null or empty."""
        return self.encode_rows(pa.array([text], pa.string()))[0].tolist()

    # Decoding

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The text of some ids in UTF-8. The blank that encoding put before
        the text goes; bytes that form no character become U+FFFD, each."""
        parts = [self.surface[i] for i in ids]
        out = b"".join(parts)
        if not (all(parts) and _is_text(out)):               # a control id, which has no text, ends a run of bytes
            out = b"".join(self._runs(ids))
        first = next((i for i in ids if self.surface[i]), None)
        return out[1:] if first in self.blank_first else out

    def _runs(self, ids: list[int]) -> Iterator[bytes]:
        held = b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                held += self.surface[i]
                continue
            while held:
                n = next((n for n in (1, 2, 3, 4) if _is_text(held[:n])), 0)
                yield held[:n] if n else "�".encode()
                held = held[max(n, 1):]
            if i is not None:
                yield self.surface[i]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@cache
def codec(path: str) -> PieceBpe:
    """One per worker and model, with the pieces it remembers. A file added by
    ``spark.sparkContext.addFile`` is found by its name."""
    return PieceBpe(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array) of each row, without begin and end ids.

    Null and empty texts have no ids. Rows that repeat, or have a null key,
    each give their row; other columns are ignored; an empty table gives an
    empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids, at = bpe.encode_rows(_column(batch, text))
            rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=[key, "ids"])

    few = docs.select(key, text)
    return few.mapInArrow(tidy(run), f"`{key}` {few.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``key`` and ``text`` of each row's ``ids``. Null or empty ids give an
    empty text; an id outside the model is an error."""
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in _column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    few = encoded.select(key, "ids")
    return few.mapInArrow(run, f"`{key}` {few.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """Digests of what ``encode`` and then ``decode`` give, in one pass:
    ``key``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas), ``decoded_sha256`` (of the decoded text in UTF-8) and
    ``lossless``. Odd rows as for ``encode``; null and empty texts have the
    digests of nothing."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = codec(path), hashlib.sha256
        decimal = [str(i) for i in range(bpe.n)]
        for batch in batches:
            column = _column(batch, text)
            flat, of = bpe.encode_rows(column)
            raw, at = text_bytes(column)
            buffer, rows = raw.tobytes(), []
            for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist())):
                ids = flat[a:b].tolist()
                back = bpe.decode_bytes(ids)
                rows.append((b - a, sha(",".join([decimal[x] for x in ids]).encode()).hexdigest(),
                             sha(back).hexdigest(), back == buffer[at[i]:at[i + 1]]))
            cells = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cells, kinds)],
                                             names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    few = docs.select(key, text)
    kind = few.schema[key].dataType.simpleString()
    return few.mapInArrow(tidy(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def op11_piece_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
