"""Corpus-wide counts without a row per token.

Counting all n-grams of a corpus, and giving each document the counts of its
own, needs a shuffle of n-grams and one back. A row per n-gram is mostly
overhead, so documents are gathered in chunks of bounded size and everything
moves in packed form:

1. ``encode``: a chunk's words become numbers into a vocabulary of 64-bit word
   hashes. The chunks are written once, to the shared folder.
2. ``requests``: each chunk asks for the totals of its distinct keys (64-bit
   n-gram hashes). Sorted keys are cut by range into slots; a row holds one
   slot's keys of one chunk, packed.
3. ``totals``: a task adds up one slot over all chunks, and answers each chunk
   in the order of its request.

A key occurs once in a request however often it is in the chunk, so a frequent
key costs one entry a chunk. Slots are ranges of hashes and so even; there is
one for every ``SLOT_TOKENS`` tokens of the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from fleetcast.llm.common import bounded_batches, give_back, mix, tidy
from fleetcast.session import scratch_path

CHUNK_BYTES = 8 << 20        # of text; a chunk ends with the document that reaches it
SLOT_TOKENS = 1 << 21
SMALL_LETTERS = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

CHUNK = "chunk long, n_tokens long, keys array<{key}>, flags binary, ends binary, vocabulary binary, tokens binary"


def arrow_type(kind: DataType) -> pa.DataType:
    """As a worker expects it for a schema in DDL: every part may be null."""
    return to_arrow_type(DataType.fromDDL(kind.simpleString()))


def squeeze(values: np.ndarray) -> bytes:
    """Numbers by byte plane, compressed: constant planes cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def stretch(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 values, as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def stretch_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(stretch(blob, np.uint64), dtype=np.uint64)


@dataclass
class Chunk:
    """Documents as word numbers: ``tokens[ends[i]:ends[i + 1]]`` are the
    words of document i, numbered by ``vocabulary`` (their hashes)."""
    number: int
    keys: list
    flags: np.ndarray
    ends: np.ndarray
    vocabulary: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: pa.Table, i: int = 0) -> Chunk:
        get = lambda name: row[name][i].as_py()
        return cls(get("chunk"), get("keys"), stretch(get("flags"), np.uint8).astype(bool), stretch(get("ends"), np.int64),
                   stretch(get("vocabulary"), np.uint64), stretch(get("tokens"), np.int32))


def encode(docs: DataFrame, name: str, text: str = "text", key: str = "doc_id", flag: Column | None = None) -> DataFrame:
    """The written chunks of ``docs``, words in small letters (A-Z). ``flag``
    is a boolean kept for each document. Null texts have no words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    few = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("flag"))
    schema = CHUNK.format(key=few.schema["key"].dataType.simpleString())
    of_keys = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind = TaskContext.get().partitionId() << 32, of_keys
        keys, flags, ends, known, tokens, size = [], [], [0], {}, [], 0

        def chunk() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
            cells = {"chunk": [number], "n_tokens": [len(tokens)], "keys": pa.array([keys], pa.list_(kind)),
                     "flags": [squeeze(np.array(flags, np.uint8))], "ends": [squeeze(np.array(ends, np.int64))],
                     "vocabulary": [squeeze(words)], "tokens": [squeeze(np.fromiter(tokens, np.int32, len(tokens)))]}
            return pa.RecordBatch.from_pydict(cells)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t, f in zip(*(c.to_pylist() for c in batch.columns)):
                words = (t or "").encode().translate(SMALL_LETTERS).split()
                tokens.extend([known.setdefault(w, len(known)) for w in words])
                keys.append(k)
                flags.append(f)
                ends.append(len(tokens))
                size += len(t or "") + 1
                if size >= CHUNK_BYTES:
                    yield chunk()
                    number += 1
                    keys, flags, ends, known, tokens, size = [], [], [0], {}, [], 0
        if keys:
            yield chunk()

    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    # rows are large: the writer has to look at its buffers after each of them
    (few.mapInArrow(tidy(run), schema).write.option("compression", "none").option("parquet.page.size.row.check.min", "1")
     .option("parquet.block.size.row.check.min", "1").option("parquet.enable.dictionary", "false").parquet(path))
    return spark.read.parquet(path)


def slots(chunks: DataFrame, tokens: int = SLOT_TOKENS) -> int:
    """Slots for the corpus: in proportion to its tokens."""
    return 1 + (chunks.agg(F.sum("n_tokens")).first()[0] or 0) // tokens


def cut(keys: np.ndarray, n: int) -> np.ndarray:
    """Borders of the n slots in ascending keys: slot s has keys[b[s]:b[s + 1]]."""
    step = (1 << 64) // n + 1
    return np.concatenate(([0], np.searchsorted(keys, np.array([step * s for s in range(1, n)], np.uint64)), [len(keys)]))


def requests(chunks: DataFrame, n: int, keys_of: Callable[[Chunk], list[tuple[np.ndarray, list[np.ndarray]]]]) -> DataFrame:
    """``keys_of`` gives ascending distinct keys, and numbers that belong to
    them, for each kind of request (0, 1, ...). One row for each kind, slot
    and chunk that has keys: slot (kind * n + slot), chunk, keys, values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield request_rows(Chunk.of(pa.Table.from_batches([batch]), i), n, keys_of)

    return chunks.mapInArrow(tidy(run), REQUEST)


REQUEST = "slot long, chunk long, keys binary, values array<binary>"


def request_rows(chunk: Chunk, n: int, keys_of) -> pa.RecordBatch:
    rows = []
    for kind, (keys, values) in enumerate(keys_of(chunk)):
        at = cut(keys, n)
        for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if b > a:
                rows.append((kind * n + s, chunk.number, squeeze_sorted(keys[a:b]), [squeeze(v[a:b]) for v in values]))
    cells = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["slot", "chunk", "keys", "values"])


ANSWER = "slot long, chunk long, values array<binary>"


def totals(asked: DataFrame, dtypes: list, answer: Callable[[int, np.ndarray, list[np.ndarray], np.ndarray], tuple[list[np.ndarray], list[np.ndarray]]]) -> DataFrame:
    """For each slot, ``answer(slot, keys, sums, first)`` gets its distinct
    keys, the sum of each kind of value over all chunks, and for each key the
    place of its first entry with a first value over 0 (-1: none). It returns
    numbers for each key, which go back to every chunk that asked (in the
    order of its request, with a last array that is 1 where the chunk's entry
    is that first one), and numbers about the whole slot, which are put in a
    row with chunk -1."""
    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(group["chunk"].to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        slot, who = group["slot"][0].as_py(), group["chunk"].to_pylist()
        parts = [stretch_sorted(k) for k in group["keys"].to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        del parts
        blobs = group["values"].to_pylist()
        del group
        columns = [np.concatenate([stretch(b[k], d) for b in blobs]) for k, d in enumerate(dtypes)]
        del blobs
        sums = [np.bincount(place, weights=c, minlength=len(keys)) for c in columns]
        first = np.full(len(keys), -1, np.int64)
        counted = np.flatnonzero(columns[0] > 0)[::-1]
        first[place[counted]] = counted                   # the earliest entry is written last
        back, about = answer(slot, keys, sums, first)
        own = np.zeros(len(place), np.uint8)
        own[first[first >= 0]] = 1
        rows = [[*(squeeze(v[place[a:b]]) for v in back), squeeze(own[a:b])] for a, b in zip(ends[:-1], ends[1:])]
        if about:
            who, rows = [*who, -1], [*rows, [squeeze(v) for v in about]]
        give_back()
        return pa.table({"slot": pa.array([slot] * len(who), pa.int64()), "chunk": pa.array(who, pa.int64()),
                         "values": pa.array(rows, pa.list_(pa.binary()))})

    add.__annotations__ = {"group": pa.Table, "return": pa.Table}
    return asked.groupBy("slot").applyInArrow(add, ANSWER)


def read_answer(found: pa.Table, kind: int, n: int, dtypes: list) -> list[np.ndarray]:
    """A chunk's answers to its requests of one kind, in the order of its keys."""
    slot = found["slot"].to_numpy()
    order = np.argsort(slot)
    order = order[(slot[order] >= kind * n) & (slot[order] < (kind + 1) * n)]
    rows = found["values"].take(pa.array(order)).to_pylist()
    return [np.concatenate([np.zeros(0, d), *(stretch(r[k], d) for r in rows)]) for k, d in enumerate(dtypes)]


def with_answers(chunks: DataFrame, answers: DataFrame, run: Callable[[Chunk, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` for each chunk with the answers that it got."""
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(Chunk.of(left), right)
        give_back()
        return out

    both.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}
    return (chunks.groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk")).applyInArrow(both, schema))


def grams(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each ``width``-word n-gram of the chunk, in order.
    A document of fewer words gives its whole sequence as one; one without
    words gives none."""
    words, n = chunk.vocabulary[chunk.tokens], len(chunk.tokens)
    lengths = np.diff(chunk.ends)
    out_doc, out_key = [], []
    if n >= width:
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        inside = doc[:n - width + 1] == doc[width - 1:]
        out_doc.append(doc[:n - width + 1][inside])
        del doc
        key = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            key += words[k:n - width + 1 + k]
            key = mix(key)
        key = key[inside]
        key += np.uint64(width)
        out_key.append(mix(key))
    for size in range(1, width):
        short = np.flatnonzero(lengths == size)
        key = np.zeros(len(short), np.uint64)
        for k in range(size):
            key = mix(key + words[chunk.ends[short] + k])
        out_doc.append(short.astype(np.int32))
        out_key.append(mix(key + np.uint64(size)))
    return np.concatenate(out_doc), np.concatenate(out_key)
