"""Quality rules with compression bands.

A text is judged by how well zstandard compresses it. Repetitive text shrinks
far more than prose, random text far less. Both the whole text and each fixed
chunk of it must lie in a band whose limits depend on the length, because
short texts compress less than long ones.

The work per text is local, so the operator is one narrow pass: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import bounded_batches, text_bytes, tidy
from fleetcast.llm.textstats import base_stats, intern_words

LEVEL = 3
CHUNK = 2048                 # bytes; a last part of under half a chunk joins the chunk before it
#: Of a text's chunks, more than this share out of band reject it.
CHUNK_SHARE = 0.25
#: (bytes from, least ratio, most ratio) of bytes to compressed bytes. Prose
#: in Latin script has 1.2 to 1.7 at 256 bytes and 2 to 3 at some kilobytes;
#: encoded or random bytes stay near 1.3, repeated phrases pass 4.
BANDS = [(0, 0.0, 2.4), (256, 1.10, 2.8), (512, 1.25, 3.2), (1024, 1.35, 3.6),
         (4096, 1.45, 4.2), (16384, 1.5, 5.0), (65536, 1.5, 6.0)]
MIN_WORDS, REPEAT_PERCENT = 10, 20

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"),
          ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("ratio", "double"),
          ("n_chunks", "long"), ("n_chunks_out", "long"), ("base_failed", "boolean"),
          ("kept", "boolean")]


def band(size: int, bands=BANDS) -> tuple[float, float]:
    """The limits for a text or chunk of ``size`` bytes."""
    low, high = bands[0][1:]
    for start, a, b in bands:
        if size >= start:
            low, high = a, b
    return low, high


def chunks(raw: bytes, size: int = CHUNK) -> list[bytes]:
    """Fixed chunks that cover the whole text."""
    cuts = list(range(0, len(raw), size)) or [0]
    if len(cuts) > 1 and len(raw) - cuts[-1] < size // 2:
        cuts.pop()
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]


def compression(raw: bytes, compressor, bands=BANDS, size: int = CHUNK) -> tuple[float, int, int, bool]:
    """(ratio of the whole text, chunks, chunks out of band, inside the bands).
    An empty text has ratio 0, no chunk out of band, and passes."""
    if not raw:
        return 0.0, 0, 0, True

    def ratio(part: bytes) -> float:
        return len(part) / len(compressor.compress(part))

    whole = ratio(raw)
    low, high = band(len(raw), bands)
    parts = chunks(raw, size)
    out = 0
    if len(parts) > 1:
        for part in parts:
            a, b = band(len(part), bands)
            out += not a <= ratio(part) <= b
    return whole, len(parts), out, low <= whole <= high and out <= CHUNK_SHARE * len(parts)


def _judge(batches: Iterator[pa.RecordBatch], n_keys: int, text: str, bands, size) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        raw, at = text_bytes(column)
        stats = base_stats(raw, at, *intern_words(raw, at)[:2])
        raw = raw.tobytes()
        found = [compression(raw[a:b], compressor, bands, size) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        ratio, n, out, inside = zip(*found) if found else ((), (), (), ())
        failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])
        values = [*stats.values(), np.array(ratio, float), np.array(n, np.int64), np.array(out, np.int64),
                  failed, ~failed & np.array(inside, bool)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(n_keys)), *map(pa.array, values)],
            names=[*batch.schema.names[:n_keys], *(k for k, _ in FIELDS)])


def quality_rules(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",),
                  bands=BANDS, chunk: int = CHUNK) -> DataFrame:
    """``keys`` and the verdict of every row of ``docs`` (FIELDS).

    ``base_failed``: under 10 words, or over 20 % of the words in repeated
    five-word windows. ``kept``: not base_failed, and the compression ratios
    lie in the bands. Null and empty texts have no words: base_failed, not
    kept, ratio 0. Repeated rows and null keys each give their own row; other
    columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    few = docs.select(*keys, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields[:len(keys)]),
                        *(f"{k} {t}" for k, t in FIELDS)])
    n = len(keys)
    return few.mapInArrow(tidy(lambda it: _judge(it, n, text, bands, chunk)), schema)


def keep_rows(docs: DataFrame, text: str = "text", bands=BANDS, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were. The
    filter runs in one narrow pass, so rows need no unique key."""
    bounded_batches(docs.sparkSession)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text)
            only = pa.RecordBatch.from_arrays([batch.column(k)], names=["text"])
            verdict = next(_judge(iter([only]), 0, "text", bands, chunk))
            yield batch.filter(verdict.column(verdict.schema.get_field_index("kept")))

    return docs.mapInArrow(tidy(kept), docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from fleetcast.llm.common import table
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("ratio", F.round("ratio", 6))
