"""Model operators on MLlib.

Fitting is MLlib's distributed training (boosted trees by histogram
aggregation, GLM by iteratively reweighted least squares), but for the random
forest (``forest``): MLlib's caches a count for every row and tree. Imputation
uses the exact training medians (A15), saved with the model, so it re-applies
them by name on any input.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, HashingTF, IDF, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.operators.forest import BINS, FEW, Forest, fit_forest, load_forest, predict, save_forest
from fleetcast.operators.training import MOST_CLASSES, class_weights, median_values, quantile_edges, value_counts, with_class_weight
from fleetcast.session import scratch_tables

CANCEL_LABELS = ("Not Cancelled", "Cancelled")


def imputer_stage(train: DataFrame, columns: list[str]) -> tuple[SQLTransformer, list[str]]:
    """A15 as a pipeline stage: coalesce each column with its training
    median. Columns without any training value are dropped (as sklearn
    does). The medians are one row of numbers, fetched once."""
    med = median_values(train, columns).first().asDict()
    kept = [c for c in columns if med[c] is not None]
    exprs = ", ".join(f"coalesce(`{c}`, CAST({float(med[c])!r} AS DOUBLE)) AS `__imp_{c}`"
                      for c in kept)
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"), kept


def _fit_forest(train: DataFrame, features: list[str], label: str, trees: int, max_depth: int, seed: int) -> Forest:
    train = train.filter(F.col(label).isNotNull())
    weights = class_weights(train, label).limit(MOST_CLASSES + 1).collect()
    if len(weights) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    with scratch_tables(train.sparkSession):
        counts = value_counts(train, features)
        med = median_values(train, features, counts=counts).first().asDict()
        kept = [c for c in features if med[c] is not None]
        edges = quantile_edges(counts, BINS, FEW)
        return fit_forest(train, kept, [med[c] for c in kept], [np.array(edges[c]) for c in kept], {float(r[label]): float(r["weight"]) for r in weights},
                          sum(r["rows"] for r in weights), label, trees, max_depth, seed)


def fit_cancellation(train: DataFrame, features: list[str], label: str = "label",
                     model: str = "random_forest", trees: int = 200, max_depth: int = 5,
                     seed: int = 42) -> Forest | PipelineModel:
    """L2/L3 + L4 + A16: impute -> assemble -> class-weighted ensemble."""
    if model != "gbt":
        return _fit_forest(train, features, label, trees, max_depth, seed)
    weighted = with_class_weight(train.withColumn(label, F.col(label).cast("double")), label,
                                 "class_weight")
    imp, kept = imputer_stage(weighted, features)
    asm = VectorAssembler(inputCols=[f"__imp_{c}" for c in kept], outputCol="features",
                          handleInvalid="keep")
    est = GBTClassifier(labelCol=label, featuresCol="features", weightCol="class_weight",
                        maxIter=trees, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[imp, asm, est]).fit(weighted)


def score(model: Forest | PipelineModel, frame: DataFrame, keep: list) -> DataFrame:
    """L5 + C17: class label text and the probability of class 1."""
    if isinstance(model, Forest):
        out = frame.select(*keep, predict(model).alias("score"))
        prediction = (F.col("score") > 0.5).cast("int")
        names = [c for c in out.columns if c != "score"]
        return out.select(*names, F.when(prediction == 1, CANCEL_LABELS[1]).otherwise(CANCEL_LABELS[0]).alias("label_text"),
                          prediction.alias("prediction"), "score")
    out = model.transform(frame)
    return out.select(*keep,
                      F.when(F.col("prediction") == 1, CANCEL_LABELS[1])
                      .otherwise(CANCEL_LABELS[0]).alias("label_text"),
                      F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("score"))


def risk_index(score_col: Column) -> Column:
    """int(round(5 + 15 * max(0, 1 - score))), half to even."""
    return F.bround(5 + 15 * F.greatest(F.lit(0.0), 1 - score_col), 0).cast("int")


# ---- S7 / S8: artifacts ---------------------------------------------------------------

def save_model(spark: SparkSession, model: Forest | PipelineModel, path: str, model_name: str,
               features: list[str], metrics: dict | None = None) -> None:
    """The pipeline or the forest's tables, plus a one-row metadata table
    (name, feature list, metrics as JSON, S11)."""
    if isinstance(model, Forest):
        save_forest(spark, model, f"{path}/forest")
    else:
        model.write().overwrite().save(f"{path}/pipeline")
    meta = spark.createDataFrame([(model_name, json.dumps(features), json.dumps(metrics or {}))],
                                 "model_name string, feature_columns string, metrics string")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


#: What a saved model's metadata row has to hold.
METADATA = "model_name string, feature_columns string, metrics string"


def load_model(spark: SparkSession, path: str, expected_name: str | None = None):
    """Pipeline, feature list and metrics of a saved model. An artifact
    without a metadata row, or of another name, is refused by a reason code
    (``model_absent``, ``model_kind``)."""
    rows = spark.read.schema(METADATA).json(f"{path}/metadata").collect() if model_exists(spark, path) else []   # one row
    if len(rows) != 1 or rows[0].model_name is None:
        raise ValueError(f"model_absent: no model metadata under {path}")
    (saved,) = rows
    if expected_name not in (None, saved.model_name):
        raise ValueError(f"model_kind: {path} holds {saved.model_name!r}")
    model = load_forest(spark, f"{path}/forest") if _exists(spark, f"{path}/forest") else PipelineModel.load(f"{path}/pipeline")
    return model, json.loads(saved.feature_columns), json.loads(saved.metrics)


def model_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/metadata")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ---- L7 / L8: Poisson demand regression --------------------------------------------

ID_BINS = 256

def fill_lags(frame: DataFrame, lag_cols: list[str]) -> tuple[DataFrame, list[str]]:
    """MLlib rejects nulls: null lag/rolling values -> 0 plus a has_ flag."""
    flags = [f"has_{c}" for c in lag_cols]
    out = frame.select(
        *[c for c in frame.columns if c not in lag_cols],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in lag_cols],
        *[F.col(c).isNotNull().cast("double").alias(f"has_{c}") for c in lag_cols])
    return out, flags


def fit_poisson(train: DataFrame, features: list[str], label: str = "demand",
                max_iter: int = 25, reg: float = 1e-4) -> PipelineModel:
    """Poisson GLM with log link (the likelihood of the reference's
    boosted Poisson model). Ids are categories: each is hashed to one of
    ID_BINS indicator columns, so the number of ids does not bound the model."""
    ids = [c for c in features if c.endswith("_id")]
    hashed = FeatureHasher(inputCols=ids, categoricalCols=ids, outputCol="id_bins", numFeatures=ID_BINS)
    asm = VectorAssembler(inputCols=[*[c for c in features if c not in ids], "id_bins"], outputCol="features", handleInvalid="keep")
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=label,
                                      featuresCol="features", maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[hashed, asm, glm]).fit(train.withColumn(label, F.col(label).cast("double")))


# ---- X1: text classification ------------------------------------------------------------

TEXT_LABELS = ("NEGATIVE", "POSITIVE")


def fit_text_classifier(train: DataFrame, text_col: str = "text", label: str = "label",
                        num_features: int = 1 << 18, max_iter: int = 20) -> PipelineModel:
    """Tokenizer -> hashed term frequencies -> IDF -> logistic
    regression. Label-agnostic: any 0/1 label column."""
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="tokens", pattern=r"(?U)\W+"),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(train.withColumn(label, F.col(label).cast("double")))


def classify_text(model: PipelineModel, frame: DataFrame, keep: list) -> DataFrame:
    """X1 output: (keep..., label, score) with score = probability of the
    predicted label, like a hosted sentiment pipeline answers."""
    out = model.transform(frame)
    p = vector_to_array("probability")
    return out.select(*keep,
                      F.when(F.col("prediction") == 1, TEXT_LABELS[1])
                      .otherwise(TEXT_LABELS[0]).alias("label"),
                      F.array_max(p).alias("score"))
