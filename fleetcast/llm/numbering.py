"""Dense numbers of rows in order, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetcast.llm.common import materialize


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order`` within ``tree``) and ``size`` (rows of
    the tree). Rows are sorted over range partitions and counted in each, so a
    tree may span any number of them; rows that are equal in ``order`` are told
    apart by where they were read, so many equal ones are spread, too."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = None, 0
        for batch in batches:
            local = []
            for t in batch.column(batch.schema.get_field_index("tree")).to_pylist():
                n = n + 1 if t == tree else 0
                tree = t
                local.append(n)
            yield batch.append_column("local", pa.array(local, pa.int64()))

    keys = ["tree", *order, "read_at"]
    ranged = (rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
              .drop("read_at").withColumn("part", F.spark_partition_id()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    ranged = materialize(ranged.mapInArrow(count, f"{kinds}, local long"), "numbered")
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("tree").orderBy("part")
    first = counts.select("tree", "part", (F.sum("n").over(before) - F.col("n")).alias("first"),
                          F.sum("n").over(W.partitionBy("tree")).alias("size"))
    return ranged.join(first, ["tree", "part"]).withColumn("pos", F.col("first") + F.col("local")).drop("part", "local", "first")
