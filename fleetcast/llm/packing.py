"""Hierarchical multi-length packing of tokenized documents.

Each document is a run of token ids with an end id. Runs are routed to tiers
of windows (512 to 4096 tokens) by length. A window opens with a document of
its tier; its gap is filled with whole documents of shorter tiers, longest
first, and then with a piece cut from one, so closed windows have no padding.
Windows of all tiers are dealt to step groups of equal token counts.

Packing reads the documents once, in place. Each task keeps at most
``BUFFER`` tokens and carries what doesn't fill a window on to its next batch;
only the last window of a task can hold padding. Nothing is shuffled, so no
source or bucket can overload a task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame

from fleetcast.llm.common import bounded_batches, table, tidy
from fleetcast.llm.pieces import Cut, Pieces, before, byte_alphabet, flatten, starts_cut

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 2
WINDOWS = (512, 1024, 2048, 4096)     # powers of two
STEP_TOKENS = 16 * WINDOWS[-1]        # of a step group
BUFFER = 1 << 20


NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Kinds of bytes, as the tokenizer's splitting pattern sees them. A tab or line
# end is a blank to it; digits are matches of their own. OTHER: not told by the byte.
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
KIND[ord("0"):ord("9") + 1] = DIGIT
LEAD = 0xC3                           # of the letters from U+00C0 to U+00FF, but for × (C3 97) and ÷ (C3 B7)
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")      # a word in lower case
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 0x20


def cut(raw: np.ndarray, at: np.ndarray) -> Cut:
    """Lower-cased runs of letters, runs of marks, and digits, without blanks.

    Cuts are made only at kinds that the bytes tell, and where a match of the
    splitting pattern ends whatever comes before: not behind an apostrophe,
    which takes some letters with it. ASCII and Latin-1 never compose with what
    is before them; a letter with a combining mark behind it keeps its case."""
    kind, low = KIND[raw], LOWER[raw]
    second = np.flatnonzero(before(raw) == LEAD)
    of = raw[second]
    second = second[(of >= 0x80) & (of < 0xC0) & (of != 0x97) & (of != 0xB7)]
    kind[second] = kind[second - 1] = LETTER
    low[second[raw[second] < 0x9F]] += 0x20
    combines = np.flatnonzero(raw[1:] >= 0xC4)            # the byte before what may be a combining mark
    low[combines] = raw[combines]
    blank, last = kind == BLANK, before(kind)
    known = (last > BLANK) & (last < OTHER) & (kind < OTHER)
    start = ~blank & ((last == BLANK) | known & ((kind != last) | (kind == DIGIT)))
    start &= ~((kind == LETTER) & (before(raw) == ord("'")))
    begins = at[:-1][at[:-1] < at[1:]]
    start[begins] = ~blank[begins]
    first = np.flatnonzero(start)
    left = np.concatenate(([0], np.cumsum(~blank)))       # bytes before each that stay
    return low[~blank], np.append(left[first], left[-1]), np.searchsorted(first, at)


class WordBpe:
    """Ids of texts by a tokenizer file. Texts are lower-cased and cut into the
    matches of its splitting pattern where bytes tell them, so a word is learnt
    once whatever its case and the marks around it. A text that holds an added
    token's string is encoded whole, and so are all texts if the file has
    another pattern or other normalizers."""

    def __init__(self, path: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.sign = self.tokenizer.model, dict(enumerate(byte_alphabet()))
        stages = [json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.own = ([x["type"] for x in stages[0].get("normalizers", [])] == NORMALIZERS
                    and [x.get("pattern") for x in stages[1].get("pretokenizers", [])] == [{"Regex": SPLIT}, None])
        self.pieces = Pieces(cut if self.own else lambda raw, at: starts_cut(raw, at, np.zeros(len(raw), bool)), self._learn)

    def _whole(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found, hard = [], []
        for i, p in enumerate(pieces):
            if not self.own:
                found.append([])
                hard.append(i)
            elif p.isalpha() and p.islower():                 # ASCII stands for itself in the vocabulary
                found.append([t.id for t in self.model.tokenize(p.decode())])
            elif LATIN.fullmatch(p):
                found.append([t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.sign))])
            else:
                found.append([])
                hard.append(i)
        for i, ids in zip(hard, self._whole([pieces[i].decode() for i in hard])):
            found[i] = ids
        return flatten(found)

    def encode_rows(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each row; none for null or empty."""
        flat, at = self.pieces.encode(column)
        rows = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        for added in self.added:
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, added), False).to_numpy(zero_copy_only=False)):
                rows[i] = np.array(self._whole([column[int(i)].as_py()])[0], np.int32)
        return rows

    def encode(self, text: str | None) -> list[int]:
        return self.encode_rows(pa.array([text], pa.string()))[0].tolist()


@cache
def encoder(path: str) -> WordBpe:
    return WordBpe(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


@dataclass
class Run:
    """A document's ids that are not packed yet: [start, len(ids))."""
    row: int                   # which document of the task
    ids: np.ndarray
    start: int = 0

    def __len__(self) -> int:
        return len(self.ids) - self.start


class Packer:
    """Packs the runs of one task. ``out`` gets (run, start, length, window
    number, offset, window size) for each piece of a closed window."""

    def __init__(self, windows=WINDOWS, step_tokens: int = STEP_TOKENS):
        self.windows, self.step_tokens = windows, step_tokens
        self.tiers = [deque() for _ in windows]
        self.waiting = self.closed = self.sequences = self.steps = 0    # closed: tokens in out
        self.step_of: list[int] = []                  # of each window
        self.room: dict[int, int] = {}                # of open step groups
        self.out: list[tuple] = []

    def tier(self, n: int) -> int:
        return next((i for i, w in enumerate(self.windows) if n <= w), len(self.windows) - 1)

    def put(self, run: Run, front: bool = False) -> None:
        longest = self.windows[-1]
        while len(run) >= longest:
            self.close([(run, run.start, longest)], longest)
            run.start += longest
        if len(run):
            queue = self.tiers[self.tier(len(run))]
            (queue.appendleft if front else queue.append)(run)
            self.waiting += len(run)

    def take(self, i: int) -> Run:
        run = self.tiers[i].popleft()
        self.waiting -= len(run)
        return run

    def close(self, pieces: list[tuple[Run, int, int]], window: int) -> None:
        offset = 0
        for run, start, length in pieces:
            self.out.append((run, start, length, self.sequences, offset, window))
            offset += length
        self.closed += offset
        self.sequences += 1
        group = next((g for g, room in self.room.items() if room >= window), None)
        if group is None:
            group, self.steps = self.steps, self.steps + 1
            self.room[group] = self.step_tokens
        self.room[group] -= window
        if not self.room[group]:
            del self.room[group]
        self.step_of.append(group)

    def fill(self, gap: int, below: int) -> list[tuple[Run, int, int]]:
        """Pieces for a gap: whole runs of the tiers up to ``below``, longest
        tier first, then a cut from the longest one waiting."""
        pieces = []
        for i in range(below, -1, -1):
            while gap and self.tiers[i] and len(self.tiers[i][0]) <= gap:
                run = self.take(i)
                pieces.append((run, run.start, len(run)))
                gap -= len(run)
        for i in range(len(self.tiers) - 1, -1, -1):
            while gap and self.tiers[i]:
                run = self.take(i)
                n = min(gap, len(run))
                pieces.append((run, run.start, n))
                gap -= n
                if n < len(run):
                    run = Run(run.row, run.ids, run.start + n)
                    self.put(run, front=True)
        return pieces

    def pack(self, last: bool = False) -> None:
        """Close all windows that can be filled; at the end, the rest too."""
        for i in range(len(self.windows) - 1, -1, -1):
            while self.tiers[i] and (self.waiting >= self.windows[i] or last):
                run = self.take(i)
                pieces = [(run, run.start, len(run))]
                pieces += self.fill(self.windows[i] - len(run), i - 1)
                n = sum(p[2] for p in pieces)
                # short of runs: the last window of the task is padded to the longest
                self.close(pieces, self.windows[i] if n == self.windows[i] else self.windows[-1])


def _pieces(batches: Iterator[pa.RecordBatch], key: str, path: str, windows, step_tokens) -> Iterator[pa.RecordBatch]:
    words, packer, task = encoder(path), Packer(windows, step_tokens), TaskContext.get().partitionId() << 32
    keys: dict[int, object] = {}
    kind, n = None, 0

    def flush() -> pa.RecordBatch:
        out, packer.out, packer.closed = packer.out, [], 0
        rows = [(keys[run.row], start, length, zlib.crc32(run.ids[start:start + length].tobytes()), len(run.ids),
                 task + sequence, offset, window, task + packer.step_of[sequence])
                for run, start, length, sequence, offset, window in out]
        cells = list(zip(*rows)) if rows else [()] * 9
        waiting = {run.row for queue in packer.tiers for run in queue}
        for row in [r for r in keys if r not in waiting]:
            del keys[row]
        return pa.RecordBatch.from_arrays([pa.array(cells[0], kind), *(pa.array(c, pa.int64()) for c in cells[1:])], names=[key, *FIELDS])

    for batch in batches:
        kind = batch.schema.field(0).type
        for k, ids in zip(batch.column(0).to_pylist(), words.encode_rows(batch.column(1))):
            keys[n] = k
            packer.put(Run(n, np.append(ids, END).astype("<u4")))
            n += 1
            if packer.waiting + packer.closed >= BUFFER:
                packer.pack()
                yield flush()
    packer.pack(last=True)
    if kind is not None:
        yield flush()


FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group")


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY,
         windows: tuple[int, ...] = WINDOWS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: ``key``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32``, ``doc_tokens`` (with the end id),
    ``sequence_id``, ``offset`` in it, ``window`` (its padded size) and
    ``step_group``.

    Null and empty texts are the end id alone. Rows that repeat, or have a
    null key, are packed one by one; other columns are ignored; an empty table
    gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    few = docs.select(key, text)
    schema = ", ".join([f"`{key}` {few.schema[key].dataType.simpleString()}", *(f"{f} long" for f in FIELDS)])
    return few.mapInArrow(tidy(lambda it: _pieces(it, key, path, windows, step_tokens)), schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
