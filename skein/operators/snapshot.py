"""The stored index: versioned snapshots of a chunk table, its postings and a file table, each behind a manifest of its own number.

A commit renames a complete manifest to a name that doesn't exist yet, which every file system does in one step or not at all; readers take the
highest number. So there is always a whole index to read, and of two writers of one number the second fails.

A pass compares checksums before anything is parsed, rewrites only changed paths (anti join and union) and drops paths that are gone. The
file table has a row for every indexed file, also for those without chunks, so unchanged files are never parsed again."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.analysis import SIMPLE, tokens
from skein.operators import bm25, postings

SCHEMA_VERSION = 4
#: Snapshots that stay for readers that have them open.
KEPT = 3


@dataclass(frozen=True)
class ReindexStats:
    added: int
    changed: int
    removed: int
    docs: int

    @property
    def any_change(self) -> bool:
        return bool(self.added or self.changed or self.removed)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema_version: int = SCHEMA_VERSION
    embedding_model: str | None = None
    embedding_dims: int | None = None
    writes: int = 0


class EmbeddingDrift(RuntimeError):
    """The stored vectors are of another model."""


def delta(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, checksum, state (added, changed, removed, same) from two tables (path, checksum)."""
    both = known.select("path", F.col("checksum").alias("old")).join(found.select("path", F.col("checksum").alias("new")), "path", "full")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return both.select("path", F.coalesce("new", "old").alias("checksum"), state.alias("state"))


def delta_stats(states: DataFrame) -> DataFrame:
    """added, changed, removed as one row."""
    return states.agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("added", "changed", "removed")))


def upserted(old: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """old without the rows of paths, and new: replacement and deletion by path."""
    return old.join(paths.select("path").distinct(), "path", "left_anti").select(*new.columns).unionByName(new)


class SnapshotStore:
    """A directory of snapshots; any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> dict[int, str]:
        found = self._fs.globStatus(self._fs_path(f"{self.root}/manifest-*.json"))
        names = [s.getPath().getName() for s in found or []]
        return {int(n[len("manifest-") : -len(".json")]): n for n in names}

    def manifest(self) -> Manifest | None:
        found = self._manifests()
        if not found:
            return None
        stream = self._fs.open(self._fs_path(f"{self.root}/{found[max(found)]}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def commit(self, manifest: Manifest) -> None:
        """Writes the manifest beside the old ones and renames it into place; older ones than the kept go afterwards."""
        new, path = self._fs_path(f"{self.root}/.manifest-{uuid.uuid4().hex}"), self._fs_path(f"{self.root}/manifest-{manifest.version:09d}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        if self._fs.exists(path) or not self._fs.rename(new, path):
            self._fs.delete(new, False)
            raise OSError(f"can't write {path}")
        for version, name in self._manifests().items():
            if version <= manifest.version - KEPT:
                self._fs.delete(self._fs_path(f"{self.root}/{name}"), False)

    def is_stale(self, model: str | None, dims: int | None) -> bool:
        m = self.manifest()
        return m is None or m.schema_version != SCHEMA_VERSION or (model is not None and (m.embedding_model, m.embedding_dims) != (model, dims))

    def check_drift(self, model: str | None) -> None:
        m = self.manifest()
        if m and model is not None and m.embedding_model is not None and m.embedding_model != model:
            raise EmbeddingDrift(f"embedding model drift: stored {m.embedding_model}, given {model}")

    def table(self, name: str) -> DataFrame | None:
        m = self.manifest()
        return None if m is None else self.spark.read.parquet(f"{self.root}/v{m.version}/{name}")

    def write(self, chunks: DataFrame, files: DataFrame, model: str | None, dims: int | None, writes: int, pattern: str = SIMPLE) -> Manifest:
        """A new snapshot; KEPT of them stay for readers that have them open, older ones go.

        Tokens take several times the room of their text: they are made anew after the sort, which carries the text alone."""
        was = self.manifest() or Manifest()
        now = Manifest(was.version + 1, SCHEMA_VERSION, model, dims, was.writes + writes)
        # By path within files, so that a path prefix skips row groups.
        rows = chunks.drop(bm25.TEXT, bm25.HEADING).sortWithinPartitions("path", "chunk_no")
        rows = rows.withColumn(bm25.TEXT, tokens(F.col("text"), pattern)).withColumn(bm25.HEADING, tokens(F.col("heading"), pattern))
        rows.write.mode("overwrite").parquet(f"{self.root}/v{now.version}/chunks")
        files.write.mode("overwrite").parquet(f"{self.root}/v{now.version}/files")
        postings.write(self.spark.read.parquet(f"{self.root}/v{now.version}/chunks"), f"{self.root}/v{now.version}")
        self.commit(now)
        self._fs.delete(self._fs_path(f"{self.root}/v{now.version - KEPT}"), True)
        return now

    def ranked(self, terms: list[str], n: int, prefix: str | None = None) -> DataFrame:
        """path, chunk_no, score of the n best chunks, from the postings."""
        return postings.ranked(self.spark, f"{self.root}/v{self.manifest().version}", terms, n, prefix)

    def known_checksums(self) -> DataFrame | None:
        files = self.table("files")
        return None if files is None else files.select("path", "checksum").dropDuplicates(["path"])

    def list_paths(self) -> DataFrame | None:
        chunks = self.table("chunks")
        return None if chunks is None else chunks.select("path").distinct()

    def count(self) -> int:
        chunks = self.table("chunks")
        return 0 if chunks is None else chunks.count()
