"""A keyed table that micro-batches add to: generations named by a manifest, compacted as they gather.

A batch is written to a folder of its own, merged by key; the next manifest lists it with the live
folders and the batch id, and takes its name in one rename.  Readers follow the newest
manifest, so they see a batch whole or not at all.  A batch id that a manifest already covers changes
nothing, and what a dead attempt left is in no manifest and is swept by the next commit.

``fan`` folders of one level are merged into one of the next, so n batches leave less than
``fan`` folders a level, and a row is rewritten once a level.  ``merge`` must not depend on the order of rows
(newest by a time of theirs, sums, extremes).  One writer a table, as one stream has; the folder may be in any
store that Spark writes to and that renames files whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docatlas.sources.folders import Folder

FAN = 8


class Generations:
    """``merge``: rows of any generations -> one row per key, with the same columns."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.spark, self.path, self.merge, self.fan = spark, path, merge, fan
        self.folder = Folder(spark, path)

    def versions(self) -> list[str]:
        return [n for n in self.folder.names("manifest") if n.endswith(".json")]

    def manifest(self, version: str | None = None) -> dict:
        """number, batch (the last one added), live (level and name of each folder)."""
        version = version or next(reversed(self.versions()), None)
        if version is None:
            return {"number": -1, "batch": -1, "live": []}
        return json.loads(self.folder.read(f"manifest/{version}"))

    def rows(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in names])

    def written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        self.merge(rows).write.parquet(f"{self.path}/data/{name}")
        return name

    def add(self, batch: DataFrame, batch_id: int) -> bool:
        """Add a batch; False if it was added before."""
        old = self.manifest()
        if batch_id <= old["batch"]:
            return False
        live = old["live"] + [[0, self.written(batch)]]
        level = 0
        while sum(x[0] == level for x in live) >= self.fan:
            many = [n for k, n in live if k == level]
            live = [x for x in live if x[0] != level] + [[level + 1, self.written(self.rows(many))]]
            level += 1
        new = {"number": old["number"] + 1, "batch": batch_id, "live": live}
        self.folder.write_once(f"manifest/{new['number']:012d}.json", json.dumps(new))
        self.sweep()
        return True

    def sweep(self) -> None:
        """Drop what neither the newest manifest nor the one before names: readers of that one may still be at work."""
        versions = self.versions()
        named = {n for v in versions[-2:] for _, n in self.manifest(v)["live"]}
        for name in self.folder.names("data"):
            if name not in named:
                self.folder.drop(f"data/{name}")
        for name in self.folder.names("manifest"):
            if name not in versions[-2:]:
                self.folder.drop(f"manifest/{name}")

    def read(self) -> DataFrame:
        """One row per key over all batches."""
        now = self.manifest()
        if not now["live"]:
            raise FileNotFoundError(f"{self.path} holds no batch yet")
        return self.merge(self.rows([n for _, n in now["live"]]))
