"""Equal-count range buckets for distributed prefix sums and numbering.

Used where a result depends on a global order (dense ids, AUC): the order is
cut into ranges by approximate quantiles, so each range holds a similar share
of rows, and each range is handled by its own task.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that the order is cut into, at any size. One range is one task's
#: work: raise it with the data, so that a range holds a few million rows.
BUCKETS = 1024


def quantile_buckets(frame: DataFrame, value_col: str, out_col: str,
                     buckets: int = BUCKETS) -> DataFrame:
    """Add ``out_col``: the range bucket of ``value_col`` (as double).

    The edges are one row of at most ``buckets - 1`` numbers (a bounded
    scalar fetched once); Bucketizer applies them with a binary search on the
    executors. Any set of edges gives correct results downstream; quantiles
    only balance the work.
    """
    accuracy = 10 * buckets
    edges = frame.agg(F.array_sort(F.array_distinct(F.percentile_approx(
        F.col(value_col).cast("double"), [i / buckets for i in range(1, buckets)],
        accuracy)))).first()[0] or []
    inner = [float(e) for e in edges] or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    tmp = f"_{out_col}_v"
    return (Bucketizer(splits=splits, inputCol=tmp, outputCol=out_col, handleInvalid="keep")
            .transform(frame.withColumn(tmp, F.col(value_col).cast("double")))
            .drop(tmp))
