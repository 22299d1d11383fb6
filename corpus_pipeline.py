"""The corpus pipeline: raw documents to packed training sequences.

Each stage applies one operator of ``fleetcast.llm`` to all rows that the
stage before it kept. Stages are written as Parquet and read again, so a lost
executor or a failed stage never costs the work of an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetcast.llm import ngram_join, packing, quality_qda, quality_rules
from fleetcast.llm.common import materialize, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules with compression bands: rejected documents go."""
    return quality_rules.keep_rows(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on the labelled rows among ``docs``:
    documents predicted 0 go."""
    return quality_qda.keep_rows(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join with five-word shingles and a similarity of 0.8:
    one document of each group stays."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near copies", near_copies),
    ("packing", sequences),
]

#: No SQL: compression, the discriminant and the tokenizer have none. The
#: stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
