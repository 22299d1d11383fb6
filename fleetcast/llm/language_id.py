"""Language identification in two steps.

The family of a text's language is predicted first, by naive Bayes over hashed
byte n-grams, with counts from every training row. Within the family, linear
support vector machines tell closely related languages apart, one for each
pair of languages; the language with most pairwise votes wins.

The machines are fitted by Spark tasks, one per pair, on a bounded sample
(about ``PER_LANGUAGE`` rows a language, each drawn by itself). Models have
fixed sizes: languages x BINS and pairs x BINS numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import bounded_batches, fold, mix, row_slices, row_sums, table, text_bytes, tidy

BINS = 4096
GRAMS = (1, 2, 3)                 # bytes
PER_LANGUAGE = 600                # sampled rows a language, for the pairwise machines
FOLDS = 5
UNKNOWN = "und"
RIDGE, STEPS = 1e-3, 150

# Families of ISO 639-1 codes. Any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "bs", "mk"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne", "sa"],
    "turkic": ["tr", "az", "kk", "ky", "uz", "tt"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "am", "mt"],
    "baltic": ["lt", "lv"],
    "malayic": ["id", "ms"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: Capitals become small letters; digits, marks and white space a blank.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the bin of each n-gram that lies in one row,
    and the row offsets of these bins."""
    low = FOLD[raw].astype(np.uint32)
    lengths = np.diff(at)
    for n in GRAMS:
        code = np.full(max(len(raw) - n + 1, 0), n, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | low[k:len(low) - n + 1 + k]
        counts = np.maximum(lengths - n + 1, 0)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        inside = np.ones(len(code), bool)
        for k in range(1, n):                       # n-grams that begin in a row's last bytes
            edge = at[1:] - k
            inside[edge[(edge >= at[:-1]) & (edge < len(code))]] = False
        yield (mix(code[inside]) >> np.uint64(52)).astype(np.int32), offsets


def bag(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, BINS) counts of hashed n-grams."""
    rows, out = len(at) - 1, np.zeros((len(at) - 1) * BINS, np.int64)
    for bins, offsets in grams(raw, at):
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
        out += np.bincount(row * BINS + bins, minlength=len(out))
    return out.reshape(rows, BINS)


def family(code: str) -> str:
    return FAMILY_OF.get(code.split("-")[0], f"other {code}")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]       # votes for the first if its machine's margin is positive
    weights: np.ndarray                # (BINS, families + pairs); means over n-grams are taken
    bias: np.ndarray

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows, f = len(at) - 1, len(self.families)
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        total, count = np.zeros((rows, self.weights.shape[1])), np.zeros(rows)
        columns = [np.ascontiguousarray(self.weights[:, k]) for k in range(self.weights.shape[1])]
        for bins, offsets in grams(raw, at):
            for k, w in enumerate(columns):
                total[:, k] += row_sums(w[bins], offsets)
            count += np.diff(offsets)
        mean = total / np.maximum(count, 1)[:, None] + self.bias
        # n-grams overlap and depend on one another: a text speaks as 40 independent ones at most
        sure = np.exp((mean[:, :f] - mean[:, :f].max(1, keepdims=True)) * np.minimum(count, 40)[:, None])
        sure /= sure.sum(1, keepdims=True)
        first = sure.argmax(1)
        margin = mean[:, f:]
        said, score = np.empty(rows, object), sure[np.arange(rows), first].copy()
        for i, name in enumerate(self.families):
            own, where = [x for x in self.languages if family(x) == name], np.flatnonzero(first == i)
            if len(own) == 1:
                said[where] = own[0]
                continue
            votes, trust = np.zeros((len(where), len(own))), np.zeros((len(where), len(own)))
            for k, (a, b) in enumerate(self.pairs):
                if a in own:
                    m = margin[where, k]
                    p = 1 / (1 + np.exp(np.clip(-3 * m, -50, 50)))
                    votes[:, own.index(a)] += m > 0
                    votes[:, own.index(b)] += m <= 0
                    trust[:, own.index(a)] += p
                    trust[:, own.index(b)] += 1 - p
            best = (votes + trust / (len(own) + 1)).argmax(1) if len(where) else np.zeros(0, int)
            said[where] = np.array(own, object)[best]
            score[where] *= trust[np.arange(len(where)), best] / (len(own) - 1)
        return said.tolist(), np.clip(score, 0.0, 1.0)


def fit_pair(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss (accelerated gradient) on rows of
    n-gram shares; y is 1 or -1. Returns weights for shares, and the bias."""
    scale = 1 / (x.std(0) + 1e-4)
    z = np.column_stack([x * scale, np.ones(len(x))])
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (2 * size / len(z) + RIDGE)
    w = ahead = np.zeros(z.shape[1])
    for t in range(STEPS):
        short = np.maximum(0, 1 - y * (z @ ahead))
        slope = -2 / len(z) * (z.T @ (y * short)) + RIDGE * np.append(ahead[:-1], 0)
        after = ahead - step * slope
        w, ahead = after, after + t / (t + 3) * (after - w)
    return w[:-1] * scale, float(w[-1])


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model from all rows with a non-null ``lang``. No such row: a model
    that answers ``und`` with score 0. The sample for the machines is drawn by
    a hash of key and text, so it doesn't depend on how the rows are split;
    rows that agree in both are in it once."""
    bounded_batches(rows.sparkSession)
    rows = (rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
            .filter("lang is not null and text is not null"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # one row a language
    languages = sorted(counts)
    families = sorted({family(x) for x in languages})
    if not languages:
        return Model([], [], [], np.zeros((BINS, 0)), np.zeros(0))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(families), BINS), np.int64)
        for batch in batches:
            names = np.array([families.index(family(x)) for x in batch.column(0).to_pylist()])
            done = 0
            for part in row_slices(batch, 1):
                raw, at = text_bytes(part.column(1))
                for bins, offsets in grams(raw, at):
                    key = np.repeat(names[done:done + part.num_rows], np.diff(offsets)) * BINS + bins
                    total += np.bincount(key, minlength=total.size).reshape(total.shape)
                done += part.num_rows
        yield pa.RecordBatch.from_pydict({"family": pa.array(range(len(families)), pa.int32()),
                                          "counts": pa.array(list(total), pa.list_(pa.int64()))})

    summed = (rows.select("lang", "text").mapInArrow(tidy(tally), "family int, counts array<long>")
              .select("family", F.posexplode("counts").alias("bin", "n")).filter("n > 0")
              .groupBy("family", "bin").agg(F.sum("n").alias("n"))
              .groupBy("family").agg(F.collect_list(F.struct("bin", "n")).alias("n")).collect())
    counted = np.zeros((len(families), BINS))
    for r in summed:
        counted[r.family, [x.bin for x in r.n]] = [x.n for x in r.n]
    smooth = counted + 0.5
    columns, bias = list(np.log(smooth / smooth.sum(1, keepdims=True))), [0.0] * len(families)

    pairs = [(a, b) for a, b in combinations(languages, 2) if family(a) == family(b)]
    if pairs:
        share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
        # each row by itself, so that many copies of one text don't all get in
        at = F.xxhash64(F.col("key"), F.col("text"), F.lit(7))
        drawn = (rows.withColumn("at", at).filter((F.shiftrightunsigned("at", 11) / float(1 << 53)) < share[F.col("lang")])
                 .dropDuplicates(["lang", "at"]).select("lang", "text", "at"))
        of = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k in languages
                            for x in (k, [i for i, p in enumerate(pairs) if k in p] or [-1])])

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at_row in range(0, batch.num_rows, 256):
                    part = batch.slice(at_row, 256)
                    x = bag(*text_bytes(part.column(1)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary()), part.column(2),
                         part.column(3)], names=["lang", "x", "at", "pair"])

        def machine(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            group = group.sort_by([("at", "ascending"), ("lang", "ascending")])       # the same sums in every run
            x = np.array([np.frombuffer(v, np.float32) for v in group["x"].to_pylist()], float)
            x /= np.maximum(x.sum(1, keepdims=True), 1)
            y = np.where(np.array(group["lang"].to_pylist()) == pairs[key[0].as_py()][0], 1.0, -1.0)
            w, b = fit_pair(x, y)
            return pa.table({"pair": pa.array([key[0].as_py()], pa.int32()), "w": [w.tolist()], "b": [b]})

        machines = (drawn.withColumn("pair", of[F.col("lang")]).mapInArrow(tidy(vectors), "lang string, x binary, at long, pair array<int>")
                    .select("lang", "x", "at", F.explode("pair").alias("pair")).filter("pair >= 0")
                    .groupBy("pair").applyInArrow(machine, "pair int, w array<double>, b double").collect())
        found = {r.pair: r for r in machines}
        for k in range(len(pairs)):
            columns.append(np.array(found[k].w) if k in found else np.zeros(BINS))
            bias.append(found[k].b if k in found else 0.0)
    return Model(languages, families, pairs, np.array(columns).T.astype(np.float32), np.array(bias))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every row, in one narrow pass.
    A text that is null or has no letter is ``und`` with score 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_slices(whole, len(keep))):
            column = batch.column(len(keep))
            raw, at = text_bytes(column)
            said, score = model.predict(raw, at)
            plain = row_sums(ASCII_LETTER[raw].astype(np.int8), at) > 0
            for i in np.flatnonzero(~plain).tolist():
                if not any(ch.isalpha() for ch in column[i].as_py() or ""):
                    said[i], score[i] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))),
                                              pa.array(said, pa.string()), pa.array(score, pa.float64())],
                                             names=[*keep, "lang_pred", "score"])

    few = docs.select(*keep, text)
    kept = ", ".join(f"`{k}` {few.schema[k].dataType.simpleString()}" for k in keep)
    return few.mapInArrow(tidy(run), f"{kept}, lang_pred string, score double")


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, held_out, lang_pred, score. Learns from rows
    outside the held-out fold that have a text and a ``lang``; repeated rows
    count as often as they occur. Null keys are not held out. An empty table
    gives an empty result."""
    marked = docs.select(key, text, lang, (fold(key, FOLDS) == 0).alias("held_out"))
    model = fit(marked.filter("not held_out"), text, lang, key)
    return predict(marked, model, text, (key, "held_out"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
