"""The index: chunks with their vectors and the hashes of the files they come from, kept up to date."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import changed, check_dimension, deleted, latest, upsert, with_embeddings
from ..operators.rules import ignored, with_rules
from ..session import few, shared_checkpoint
from ..sources.chunking import chunk
from ..sources.embedder import Embedder, HashedEmbedder

CHUNK = (
    "chunk_id string, path string, file_hash string, language string, symbol string, signature string, docstring string, content string, "
    "start_line int, end_line int, embedding array<double>, indexed_at timestamp, project_id string"
)
STATE = "path string, hash string, project_id string"
STATS = "project_id string, files bigint, chunks bigint, symbols bigint, last_indexed_at timestamp"
#: Parts of each project, by the hash of the path: an update rewrites only those that its paths fall in.
BUCKETS = 16


class Index:
    """Two tables under a folder, partitioned by project and bucket of the path: ``chunks`` and ``state`` (path, hash).

    An update rewrites the buckets its paths fall in and no others.  What is written is balanced by measured size, so
    that neither a project nor a bucket is one task's work.  A bucket that has no rows any more keeps one row without a
    path, which readers pass over.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.embedder, self.buckets = spark, folder, embedder or HashedEmbedder(), buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, name))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        path, system = self._path(name)
        # the file system of the path, local or shared, says whether the table exists yet
        if not system.exists(path):
            return self.spark.createDataFrame([], schema + ", bucket int")
        return self.spark.read.schema(schema + ", bucket int").parquet(os.path.join(self.folder, name)).where("path is not null")

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK).drop("bucket")

    def state(self) -> DataFrame:
        return self._read("state", STATE).drop("bucket")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))

    def _write(self, name: str, schema: str, rows: DataFrame, affected: DataFrame) -> None:
        """Replaces the buckets in ``affected`` (project_id, bucket) with ``rows``."""
        columns = [c.split()[0] for c in schema.split(", ")]
        # the rows come in part from the table that is written, so they are cut off from it first
        cut = shared_checkpoint(self.spark, self._bucketed(rows.select(*columns)))
        empty = affected.join(cut.select("project_id", "bucket").distinct(), ["project_id", "bucket"], "left_anti")
        every = cut.unionByName(empty, allowMissingColumns=True)
        writer = every.hint("rebalance", F.col("project_id"), F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("project_id", "bucket").parquet(os.path.join(self.folder, name))

    def update(self, files: DataFrame, projects: DataFrame | None = None, ignores: DataFrame | None = None, gone: bool = True) -> dict[str, int]:
        """Brings the index in line with ``files`` (project_id, path, rel_path, content, hash, size); returns the counts.

        Files that the rules or ignore files keep out count as not there.  With ``gone`` the files are all there are
        of their projects, and paths that are no longer among them leave the index.
        """
        files = latest(files, "path", "seen_at") if "seen_at" in files.columns else files
        if projects is not None:
            files = with_rules(files, projects).where("indexed").drop("indexed")
        if ignores is not None:
            root = F.expr("left(path, greatest(length(path) - length(rel_path) - 1, 0))")
            files = ignored(files.withColumn("root", root), ignores).where(~F.col("ignored")).drop("ignored", "root")
        files = files.where(F.col("content").isNotNull() & F.col("project_id").isNotNull())
        files = files.withColumn("hash", F.sha2("content", 256))
        state = self.state()
        touched = files.select("project_id").distinct()
        fresh = shared_checkpoint(self.spark, changed(files.select("project_id", "path", "content", "hash"), state.select("path", "hash")))
        left = shared_checkpoint(self.spark, deleted(files, state.join(touched, "project_id", "left_semi")).select("path") if gone else fresh.select("path").limit(0))
        new = with_embeddings(chunk(fresh), self.chunks().select("chunk_id", "embedding"), self.embedder.embed)
        new = shared_checkpoint(self.spark, new.withColumn("indexed_at", F.current_timestamp()))
        if not new.isEmpty():
            check_dimension(new, self.embedder.dim)
        stale = fresh.select("path").unionByName(left).distinct()
        affected = shared_checkpoint(self.spark, self._affected(fresh, left))
        self._write("chunks", CHUNK, upsert(self._kept("chunks", CHUNK, affected, stale), new), affected)
        hashes = self._kept("state", STATE, affected, stale).unionByName(fresh.select("path", "hash", "project_id").dropDuplicates(["path"]))
        self._write("state", STATE, hashes, affected)
        return {"changed": fresh.count(), "deleted": left.count(), "chunks": new.count()}

    def _affected(self, fresh: DataFrame, left: DataFrame) -> DataFrame:
        gone = self.state().join(left.select("path"), "path", "left_semi")
        return self._bucketed(fresh.select("project_id", "path").unionByName(gone.select("project_id", "path"))).select("project_id", "bucket").distinct()

    def _kept(self, name: str, schema: str, affected: DataFrame, stale: DataFrame) -> DataFrame:
        """The rows of the affected buckets that stay; only those buckets are read."""
        return self._read(name, schema).join(few(affected), ["project_id", "bucket"], "left_semi").drop("bucket").join(stale.select("path"), "path", "left_anti")

    def update_paths(self, paths: DataFrame, files: DataFrame, projects: DataFrame | None = None) -> dict[str, int]:
        """Reindexes single paths: those among ``files`` are indexed, the others of ``paths`` leave the index."""
        absent = paths.join(files.select("path"), "path", "left_anti").select("path")
        hit = shared_checkpoint(self.spark, self.state().join(absent, "path", "left_semi").select("project_id", "path"))
        if not hit.isEmpty():
            affected = shared_checkpoint(self.spark, self._bucketed(hit).select("project_id", "bucket").distinct())
            self._write("chunks", CHUNK, self._kept("chunks", CHUNK, affected, hit), affected)
            self._write("state", STATE, self._kept("state", STATE, affected, hit), affected)
        counts = self.update(files, projects, gone=False)
        return counts | {"deleted": hit.count()}

    def remove(self, project_id: str) -> None:
        """Takes a project out of the index."""
        for name in ("chunks", "state"):
            path, system = self._path(os.path.join(name, f"project_id={project_id}"))
            system.delete(path, True)

    def rebuild(self, files: DataFrame, projects: DataFrame | None = None, ignores: DataFrame | None = None) -> dict[str, int]:
        """Forgets the projects of ``files`` and indexes them anew, whatever state an earlier run left: all their buckets are emptied in one write."""
        named = files.select("project_id").where("project_id is not null").distinct()
        for name, schema in (("chunks", CHUNK), ("state", STATE)):
            old = shared_checkpoint(self.spark, self._read(name, schema).join(named, "project_id", "left_semi").select("project_id", "bucket").distinct())
            if not old.isEmpty():
                self._write(name, schema, self.spark.createDataFrame([], schema), old)
        return self.update(files, projects, ignores)

    def save_stats(self) -> DataFrame:
        """Counts each project's files, chunks and symbols, and keeps them in the table ``stats``."""
        per = self.chunks().groupBy("project_id").agg(F.count_distinct("path").alias("files"), F.count("*").alias("chunks"), F.count_if(F.col("symbol") != "").alias("symbols"), F.max("indexed_at").alias("last_indexed_at"))
        per.write.mode("overwrite").parquet(os.path.join(self.folder, "stats"))
        return self.stats()

    def stats(self) -> DataFrame:
        """The counts last saved; none before the first time."""
        path, system = self._path("stats")
        return self.spark.read.schema(STATS).parquet(os.path.join(self.folder, "stats")) if system.exists(path) else self.spark.createDataFrame([], STATS)
