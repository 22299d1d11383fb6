"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a short vector of transformed text statistics. Each
class (quality 0, quality 1) is a Gaussian with its own shrunk covariance. The
score is the posterior of class 1, from the difference of the two Mahalanobis
log-densities. The Cholesky factors are computed once and travel with the
model.

Fitting needs only class sums of x and x x', so it reads every training row:
tasks add up partial sums and Spark adds those. Nothing but the sums
(1 + d + d * d numbers a class) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import SPACE, bounded_batches, fold, materialize, table, text_bytes, tidy
from fleetcast.llm.textstats import IS_START, base_stats, class_counts, intern_words

FEATURES = ["words", "word_length", "symbols", "upper", "digits", "marks", "non_ascii", "dup_lines",
            "repeats", "types", "line_words", "controls"]
THRESHOLD = 0.3
#: Shrinkage: share of the pooled covariance in each class covariance, and of
#: its diagonal in the result; RIDGE is added to the diagonal (unit variances).
TO_POOLED, TO_DIAGONAL, RIDGE = 0.10, 0.10, 0.02
FOLDS = 5


def _flags(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


UPPER, DIGIT = _flags(range(65, 91)), _flags(range(48, 58))
LETTER = _flags([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
MARK = _flags(b"!?;:\"'()[]{}=+/\\@~^_`")
CONTROL = _flags([*range(0, 9), *range(14, 32), 127])
NEWLINE, HIGH = _flags(b"\n"), _flags(range(0xC0, 0x100))


def features(text: pa.Array) -> np.ndarray:
    """(rows, d) transformed statistics of whole texts; zeros for an empty one."""
    raw, at = text_bytes(text)
    ids, word_at, _ = intern_words(raw, at)
    base = base_stats(raw, at, ids, word_at)
    count = lambda flags: class_counts(raw, at, flags).astype(float)
    n = base["n_words"].astype(float)
    per_word, per_char = np.maximum(n, 1), np.maximum(count(IS_START), 1)
    types = np.zeros(len(n))
    if len(ids):
        row = np.repeat(np.arange(len(n)), np.diff(word_at))
        seen = np.sort(row * (int(ids.max()) + 1) + ids)
        first = np.concatenate(([True], seen[1:] != seen[:-1]))
        types = np.bincount(seen[first] // (int(ids.max()) + 1), minlength=len(n)).astype(float)
    share = lambda x: np.sqrt(np.minimum(x, 4.0))  # noqa: E731  spreads the small shares
    return np.column_stack([
        np.log1p(n),
        np.log1p((base["word_chars"] + 50) / (n + 10)),
        share(base["n_symbols"] / per_word),
        share(count(UPPER) / (count(LETTER) + 30)),
        share(count(DIGIT) / per_char),
        share(count(MARK) / per_word),
        share(count(HIGH) / per_char),
        share(base["n_dup_lines"] / (count(NEWLINE) + 4)),
        share(base["n_repeat_words"] / (n + 5)),
        np.log((types + 1) / (n + 1)) + 0.15 * np.log1p(n),   # fewer types are normal in longer texts
        np.log1p(n / (count(NEWLINE) + 1)),
        share(count(CONTROL & ~SPACE) / per_char),
    ])


@dataclass(frozen=True)
class Model:
    centre: np.ndarray            # of the scaling, (d,)
    scale: np.ndarray
    means: np.ndarray             # (2, d), scaled
    inverse: np.ndarray           # (2, d, d): inverses of the Cholesky factors
    constant: np.ndarray          # (2,): log prior less half the log determinant
    prior: float                  # answer where a class has no row

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [c - 0.5 * (((z - m) @ low.T) ** 2).sum(axis=1)
                   for m, low, c in zip(self.means, self.inverse, self.constant)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def model_from_sums(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> Model:
    """n (2,), sums of x (2, d) and of x x' (2, d, d) by class. With no rows
    in one class the score is the constant (n1 + 1) / (n0 + n1 + 2)."""
    d = first.shape[1]
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 1:
        return Model(np.zeros(d), np.ones(d), np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), prior)
    mean = first / n[:, None]
    spread = [second[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / n.sum()
    total = second.sum(0) / n.sum() - np.outer(first.sum(0), first.sum(0)) / n.sum() ** 2
    scale = np.sqrt(np.maximum(np.diag(total), 0))
    scale[scale < 1e-9] = 1.0
    centre = first.sum(0) / n.sum()
    unit = np.outer(scale, scale)
    inverse, constant = [], []
    for c in (0, 1):
        cov = ((1 - TO_POOLED) * spread[c] + TO_POOLED * pooled) / unit
        cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky((cov + cov.T) / 2)
        inverse.append(np.linalg.inv(low))
        constant.append(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(low)).sum())
    return Model(centre, scale, (mean - centre) / scale, np.array(inverse), np.array(constant), prior)


def feature_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``x`` (array of doubles) for every row, in one narrow pass."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=[key, "x"])

    few = docs.select(key, text)
    return few.mapInArrow(tidy(run), f"`{key}` {few.schema[key].dataType.simpleString()}, x array<double>")


def fit(labelled: DataFrame, d: int = len(FEATURES)) -> Model:
    """``labelled``: ``x`` and ``label`` (0 or 1; other rows are passed over).
    Uses all rows. An empty frame gives the constant score 0.5."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                part = x[label == c]
                total[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        yield pa.RecordBatch.from_pydict({
            "c": np.repeat([0, 1], total.shape[1]).astype(np.int32),
            "k": np.tile(np.arange(total.shape[1], dtype=np.int32), 2), "v": total.ravel()})

    rows = (labelled.filter("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
            .mapInArrow(sums, "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect())
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r.c, r.k] = r.v
    return model_from_sums(total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d))


def training_rows(x: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Feature rows joined with their labels, without the held-out fold. A
    document labelled twice counts twice; null labels and keys don't count."""
    known = labels.select(F.col(key).alias("_k"), F.col(label).alias("label")).filter("label is not null")
    return x.filter(fold(key, FOLDS) != 0).join(known, F.col(key) == F.col("_k")).select("x", "label")


def score_rows(x: DataFrame, model: Model, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` for every feature row."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"])

    few = x.select(key, (fold(key, FOLDS) == 0).alias("held_out"), "x")
    kind = few.schema[key].dataType.simpleString()
    return few.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score (0 to 1, higher:
    label 1 likelier), predicted (1 from THRESHOLD on).

    Null and empty texts have zero statistics and are scored like any other;
    repeated rows each get theirs; a null key is never held out and never
    labelled; an empty table gives an empty result.
    """
    x = materialize(feature_table(docs, text, key), "quality-features")
    return score_rows(x, fit(training_rows(x, labels, key)), key)


def keep_rows(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns as they were."""
    x = feature_table(docs.filter(fold(key, FOLDS) != 0), text, key)
    model = fit(training_rows(x, labels, key))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(batch.schema.get_field_index(text))))
            yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(tidy(kept), docs.schema)


def op6_quality_qda(spark, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
