"""State of a stream as a log of mergeable parts.

A micro-batch appends one folder with what it adds; reading merges the live
folders by an aggregate that doesn't care about their order. When a level has
``every`` folders, they are merged into one of the next level, so there are at
most ``every - 1`` a level and a row is rewritten once a level.

A manifest per batch (one small file) names the live folders. The newest two
manifests are kept, with the folders they name: a batch that is tried again
starts from the manifest before its own, and finds all of it. So neither the
files nor the listing grow with the number of batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

EVERY = 8


class MergeLog:
    """``merge`` makes one frame of the union of parts, in ``schema`` too, and
    must give the same whatever parts it is applied to first."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType, merge: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.spark, self.base, self.schema, self.merge, self.every = spark, base, schema, merge, every
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self) -> list[int]:
        folder = self._path(f"{self.base}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, batch: int) -> list[list]:
        with_lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._path(f"{self.base}/manifest/{batch:012d}.json"))
        try:
            return json.loads(with_lines.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, batch: int, live: list[list]) -> None:
        name, draft = self._path(f"{self.base}/manifest/{batch:012d}.json"), self._path(f"{self.base}/manifest/{batch:012d}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(live).encode()))
        out.close()
        self._fs.delete(name, False)                          # of an earlier try of this batch
        self._fs.rename(draft, name)

    def live(self, before: int | None = None) -> list[list]:
        """[level, folder] of the live folders, after all batches or before one."""
        done = [b for b in self.manifests() if before is None or b < before]
        return self._load(done[-1]) if done else []

    def read(self, before: int | None = None) -> DataFrame:
        return self.merge(self._frame([folder for _, folder in self.live(before)]))

    def _frame(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def append(self, part: DataFrame, batch: int) -> None:
        """Adds a batch's part (merged already). May be tried again."""
        live = self.live(batch)

        def write(frame: DataFrame, level: int) -> list:
            folder = f"{self.base}/level={level}/batch={batch:012d}"
            frame.write.mode("overwrite").parquet(folder)
            return [level, folder]

        live.append(write(part, 0))
        level = 0
        while len(full := [x for x in live if x[0] == level]) >= self.every:
            live = [x for x in live if x[0] != level]
            live.append(write(self.merge(self._frame([folder for _, folder in full])), level + 1))
            level += 1
        self._save(batch, live)
        self._forget()

    def _forget(self) -> None:
        """Deletes what only manifests before the newest two name."""
        done = self.manifests()
        for old in done[:-2]:
            needed = {folder for b in done[-2:] for _, folder in self._load(b)}
            for _, folder in self._load(old):
                if folder not in needed:
                    self._fs.delete(self._path(folder), True)
            self._fs.delete(self._path(f"{self.base}/manifest/{old:012d}.json"), False)
