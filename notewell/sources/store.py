"""A store of snapshots: notes, aliases and vectors as Parquet under one folder.

A snapshot is written in full beside the others and becomes current when a
small file that names it appears under the next number. Such files are never
changed or deleted, and the highest number counts: readers never see half of a
snapshot, a failed write changes nothing, and of two writers one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.functions.text import normalized
from notewell.schema import ALIASES, MEMORIES, VECTORS

TABLES = {"memories": MEMORIES, "aliases": ALIASES, "vectors": VECTORS}


def migrated(memories: DataFrame) -> DataFrame:
    """memories of any older form in today's columns: missing ones get their defaults, blank normalised texts are made."""
    have = set(memories.columns)
    out = memories
    plain = {"tags": F.lit("[]"), "pinned": F.lit(0), "metadata_json": F.lit("{}"), "updated_at": F.col("created_at") if "created_at" in have else F.lit(0)}
    for name, value in plain.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in have else value)
    made = normalized(F.col("note"))
    out = out.withColumn("note_normalized", F.when(F.coalesce(F.col("note_normalized"), F.lit("")) == "", made).otherwise(F.col("note_normalized")) if "note_normalized" in have else made)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORIES])


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, str]]:
        """Number and name of the files that name snapshots, in order."""
        path, files = self._path("pointers")
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted((int(n.partition("-")[0]), n) for n in names if n.partition("-")[0].isdigit())

    def _named(self) -> dict:
        pointers = self._pointers()
        if not pointers:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/pointers/{pointers[-1][1]}").first()["value"])

    def current(self) -> str | None:
        return self._named().get("version")

    def batches(self) -> dict[str, int]:
        """The last batch of each stream that the current snapshot has."""
        return self._named().get("batches", {})

    def read(self, name: str) -> DataFrame:
        """A table of the current snapshot; empty if there is none."""
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        path = f"{self.folder}/{version}/{name}"
        found = self.spark.read.option("basePath", path).parquet(path)
        return migrated(found) if name == "memories" else found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])

    def write(self, batch: tuple[str, int] | None = None, **tables: DataFrame) -> str:
        """A new snapshot; tables that aren't given are taken from the current one. batch is the stream's name and the number of its batch."""
        version, pointers, batches = f"v-{uuid.uuid4().hex}", self._pointers(), self.batches()
        for name in TABLES:
            rows = tables[name] if name in tables else self.read(name)
            if name == "memories":  # a repo's rows lie together, so that a filter on repo reads little
                rows = rows.sortWithinPartitions("repo", "row_id")
            rows.write.parquet(f"{self.folder}/{version}/{name}")
        number = pointers[-1][0] + 1 if pointers else 1
        draft, files = self._path(f"drafts/{version}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "batches": batches | (dict([batch]) if batch else {})}).encode()))
        out.close()
        target, _ = self._path(f"pointers/{number:012d}-pointer")
        files.mkdirs(target.getParent())
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"another writer made snapshot {number} of {self.folder}")
        return version

    def memories(self, repo: str | None = None) -> DataFrame:
        rows = self.read("memories")
        return rows if repo is None else rows.where(F.col("repo") == repo)
