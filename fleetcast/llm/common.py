"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.session import materialize  # noqa: F401  (re-exported for the operators)

#: Arrow batches handed to Python are cut at this many bytes, so that a batch
#: of long texts does not fill a worker.
BATCH_BYTES = 4 << 20

#: Bytes 0x20 and 0x09-0x0D separate words: words are ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; a value set by the site stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def fold(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; 0 marks a held-out row. A null
    id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod, F.lit(1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with the UTF-8 bytes of all rows, and the n + 1 offsets of
    the rows in it. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def give_back() -> None:
    """Returns freed memory to the system. Python workers outlive their tasks,
    and the allocator would keep what large arrays held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):        # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over its batches that gives memory back at the end."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def row_slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text in column ``text``; a
    longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each row's range; 0 for an empty range."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out = np.zeros(len(offsets) - 1, kind)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        # only non-empty rows start a segment; the ranges have no gaps between them
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=kind)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (splitmix64 finaliser) of uint64 values."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
