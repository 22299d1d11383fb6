"""Language model scores with Katz backoff.

A bigram that was seen c times in training keeps the share d(c) c / c(h) of
its history h, with Good-Turing discounts d for counts up to ``TURING``. What
the discounts free goes to the words never seen after h, in proportion to
their unigram probability:

    P(w | h) = d(c) c(h, w) / c(h)          if c(h, w) > 0
             = a(h) P(w)                    else
    a(h) = (1 - sum of the seen shares) / (1 - sum of P over the seen words)

P(w) is discounted in the same way and keeps what is free for the one class of
unknown words, so both levels add up to 1 exactly. A history that was never
seen backs off with weight 1. Histories begin with a start mark; the end of a
text is a token.

All counts are those of the whole training part. They are gathered slot by
slot (chunks.py) and written as tables partitioned by order; the backoff
weights need one more round of sums over all seen bigrams, for which the first
chunk that counted a bigram adds its terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm import chunks as C
from fleetcast.llm.common import bounded_batches, fold, mix, row_sums, table
from fleetcast.session import scratch_path

TURING = 5                       # counts above are not discounted
FOLDS = 10
#: Keys of the marks; words have xxh3 hashes.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass
class Sequence:
    """A chunk's documents with their end marks, as numbers of its words."""
    words: np.ndarray            # ascending distinct keys of words and marks
    after: np.ndarray            # number of each token, end marks included
    before: np.ndarray           # number of the token before it, or of START
    ends: np.ndarray             # documents are [ends[i], ends[i + 1])
    pair: np.ndarray             # number of each token's bigram
    first: np.ndarray            # bigrams: number of the history
    second: np.ndarray           # and of the word
    keys: np.ndarray             # and its key, ascending

    @classmethod
    def of(cls, chunk: C.Chunk) -> Sequence:
        v = len(chunk.vocabulary)
        words, number = np.unique(np.concatenate((chunk.vocabulary, [END, START])), return_inverse=True)
        documents = len(chunk.ends) - 1
        after = number[np.insert(chunk.tokens.astype(np.int64), chunk.ends[1:], v)]
        ends = chunk.ends + np.arange(documents + 1)
        before = np.concatenate(([0], after[:-1]))
        before[ends[:-1]] = number[v + 1]
        kinds, pair = np.unique(before * len(words) + after, return_inverse=True)
        first, second = kinds // len(words), kinds % len(words)
        keys = mix(mix(words[first]) + words[second])
        order = np.argsort(keys)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return cls(words, after, before, ends, place[pair], first[order], second[order], keys[order])


def counts(chunk: C.Chunk) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Training counts of the chunk's words and bigrams. START is counted as a
    history, once a document."""
    s = Sequence.of(chunk)
    learn = np.repeat(~chunk.flags, np.diff(s.ends))
    single = np.bincount(s.after[learn], minlength=len(s.words))
    single[np.searchsorted(s.words, START)] = (~chunk.flags).sum()
    double = np.bincount(s.pair[learn], minlength=len(s.keys))
    return [(s.words, [single.astype(np.uint64)]), (s.keys, [double.astype(np.uint64)])]


def discounts(of_count: np.ndarray, most: int = TURING) -> np.ndarray:
    """Katz's discounts for counts 0 to ``most``; ``of_count[r]`` is how many
    n-grams occur r times (r up to most + 1). Where Good-Turing has no answer
    between 0 and 1 (small or uneven corpora), (r - 0.5) / r is taken."""
    out = np.ones(most + 1)
    n1 = of_count[1]
    cut = (most + 1) * of_count[most + 1] / n1 if n1 else 1.0
    for r in range(1, most + 1):
        d = ((r + 1) * of_count[r + 1] / (r * of_count[r]) - cut) / (1 - cut) if of_count[r] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class Model:
    tokens: int                  # N: training tokens, end marks included
    types: int                   # V
    single: np.ndarray           # discounts by count
    double: np.ndarray
    unknown: float               # probability of the class of unknown words

    def share(self, discount: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return c * discount[np.where(c <= TURING, c, 0).astype(np.int64)]

    def word(self, c: np.ndarray) -> np.ndarray:
        """P(w) by the word's count."""
        return np.where(c > 0, self.share(self.single, c) / max(self.tokens, 1), self.unknown)


def model_of(stats: np.ndarray) -> Model:
    """stats (2, 3 + TURING): tokens, types, and n-grams that occur 1 to
    TURING + 1 times, of words and bigrams."""
    n, v = int(stats[0, 0]), int(stats[0, 1])
    of_count = np.concatenate((np.zeros((2, 1)), stats[:, 2:]), axis=1)
    single, double = discounts(of_count[0]), discounts(of_count[1])
    if n and not of_count[0, 1:TURING + 1].any():        # nothing to discount: half a token is set free
        single = single * (1 - 0.5 / n)
    r = np.arange(TURING + 1)
    low = of_count[0, :TURING + 1]
    kept = (single * r * low).sum() + (n - (r * low).sum()) * single[0]
    return Model(n, v, single, double, 1.0 if not n else 1 - kept / n)


def back_off(c: np.ndarray, seen: np.ndarray, lower: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(a(h), factor of the seen shares) for histories with count c, sum of
    discounted counts ``seen`` and sum ``lower`` of P over the seen words.
    Where nothing was discounted, half a count is set free."""
    some = c > 0
    safe = np.where(some, c, 1)
    factor = np.where(some & (seen > c - 0.5), (c - 0.5) / np.maximum(seen, 0.5), 1.0)
    weight = (1 - factor * seen / safe) / np.maximum(1 - lower, model.unknown)
    return np.where(some, weight, 1.0), factor


def count_tables(parts: DataFrame, n: int, name: str) -> DataFrame:
    """Totals of words (kind 0) and bigrams (kind 1): answers to the chunks and
    counts of counts, written partitioned by kind."""
    def answer(slot, keys, sums, first):
        c = np.rint(sums[0]).astype(np.uint64)
        word = c[(keys != START) & (c > 0)] if slot < n else c[c > 0]
        of_count = np.bincount(np.minimum(word, TURING + 2).astype(np.int64), minlength=TURING + 3)[1:TURING + 2]
        return [c], [np.concatenate(([word.sum(), len(word)], of_count)).astype(np.uint64)]

    spark = parts.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    found = C.totals(C.requests(parts, n, counts), [np.uint64], answer)
    (found.withColumn("kind", (F.col("slot") >= n).cast("int")).write.partitionBy("kind").option("compression", "none").parquet(path))
    return spark.read.schema(f"{C.ANSWER}, kind int").parquet(path)


def train(answers: DataFrame) -> Model:
    """Adds up the slots' counts of counts: 2 x (3 + TURING) numbers."""
    width = 3 + TURING

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            for kind, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[kind] += C.stretch(values[0], np.uint64)
        yield pa.RecordBatch.from_pydict({"kind": np.repeat(np.arange(2, dtype=np.int32), width),
                                          "k": np.tile(np.arange(width, dtype=np.int32), 2), "v": total.ravel()})

    rows = (answers.filter("chunk = -1").select("kind", "values").mapInArrow(add, "kind int, k int, v double")
            .groupBy("kind", "k").agg(F.sum("v").alias("v")).collect())
    stats = np.zeros((2, width))
    for r in rows:
        stats[r.kind, r.k] = r.v
    return model_of(stats)


def scores(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Trains on the documents that aren't ``held_out`` and scores all: key,
    held_out, n_tokens (end mark included), n_known, train_tokens, base_score
    (unigrams with 0.1 added) and score (log10 probability of the text).

    Null and empty texts are the end mark alone. Repeated rows count as often
    as they occur; a null key has its row; extra columns are ignored. Without
    any training document all words are unknown, with probability 1. An empty
    table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    parts = C.encode(docs, "lm-chunks", text, key, held_out)
    n = C.slots(parts)
    answers = count_tables(parts, n, "lm-counts")
    model = train(answers)
    answers = answers.drop("kind")

    def sums(chunk: C.Chunk, found: pa.Table) -> pa.Table:
        """Asks for the backoff sums of the chunk's words as histories."""
        s = Sequence.of(chunk)
        c, own = C.read_answer(found, 0, n, [np.uint64, np.uint8])
        cc, first = C.read_answer(found, 1, n, [np.uint64, np.uint8])
        at = np.flatnonzero(first)
        seen = np.bincount(s.first[at], weights=model.share(model.double, cc[at]), minlength=len(s.words))
        lower = np.bincount(s.first[at], weights=model.word(c)[s.second[at]], minlength=len(s.words))
        once = np.where(own > 0, c, 0).astype(float)
        return pa.Table.from_batches([C.request_rows(chunk, n, lambda _: [(s.words, [seen, lower, once])])])

    def weights(slot, keys, sums_, first):
        return list(back_off(sums_[2], sums_[0], sums_[1], model)), []

    asked = C.with_answers(parts, answers, sums, C.REQUEST)
    backed = (C.totals(asked, [np.float64] * 3, weights)
              .select((F.col("slot") + 2 * n).alias("slot"), "chunk", "values"))

    def score(chunk: C.Chunk, found: pa.Table) -> pa.Table:
        s = Sequence.of(chunk)
        c, _ = C.read_answer(found, 0, n, [np.uint64, np.uint8])
        cc, _ = C.read_answer(found, 1, n, [np.uint64, np.uint8])
        weight, factor = C.read_answer(found, 2, n, [np.float64, np.float64])
        c, cc = c.astype(float), cc.astype(float)
        low = model.word(c)
        p = np.where(cc > 0, factor[s.first] * model.share(model.double, cc) / np.maximum(c[s.first], 1),
                     weight[s.first] * low[s.second])
        base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        return pa.table({
            key: pa.array(chunk.keys, arrow_key), "held_out": chunk.flags, "n_tokens": np.diff(s.ends),
            "n_known": row_sums((c > 0).astype(np.int8)[s.after], s.ends),
            "train_tokens": np.full(len(chunk.keys), model.tokens, np.int64),
            "base_score": row_sums(base[s.after], s.ends), "score": row_sums(np.log10(p)[s.pair], s.ends)})

    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType
    arrow_key = C.arrow_type(kind)
    schema = (f"`{key}` {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
    return C.with_answers(parts, answers.unionByName(backed), score, schema)


def op10_katz_scores(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), fold("doc_id", FOLDS) == 0)
