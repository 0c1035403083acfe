"""The state of an index: what changed, what is gone, what is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import few


class DimensionError(ValueError):
    """Vectors of different lengths."""


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """The files (path, hash) whose hash is not the stored one; a null hash counts as changed."""
    old = state.select("path", F.col("hash").alias("_stored"))
    return files.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_stored")) | F.col("hash").isNull()).drop("_stored")


def deleted(files: DataFrame, state: DataFrame) -> DataFrame:
    """The stored paths that no file has any more."""
    return state.join(files.select("path").distinct(), "path", "left_anti")


def latest(files: DataFrame, key: str = "file_id", arrival: str = "seen_at") -> DataFrame:
    """One row per key, a null key being one too: of re-sent rows the last to arrive.

    Which keys came more than once is found on the key alone; the other rows, texts and all, are not moved as long as
    those keys are few enough to be sent to the tasks.
    """
    again = few(files.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(arrival))
    several = files.join(again, same, "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return files.join(again, same, "left_anti").unionByName(several)


def between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind): what changed from one snapshot (path, hash) to the next: ``create``, ``write`` or ``remove``."""
    old, new = before.select("path", F.col("hash").alias("_old"), F.lit(True).alias("_had")), after.select("path", F.col("hash").alias("_new"), F.lit(True).alias("_has"))
    met = old.join(new, "path", "full")
    kind = F.when(F.col("_had").isNull(), "create").when(F.col("_has").isNull(), "remove").when(~F.col("_old").eqNullSafe(F.col("_new")), "write")
    return met.select("path", kind.alias("kind")).where("kind is not null")


def upsert(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``store`` with the rows of ``new`` in place of those with the same key; of equal keys in ``new`` the lowest start line stays."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("start_line"))
    once = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kept = store.join(once.select(key), key, "left_anti")
    return kept.unionByName(once, allowMissingColumns=True)


def delete_paths(store: DataFrame, paths: DataFrame) -> DataFrame:
    return store.join(paths.select("path").distinct(), "path", "left_anti")


def dimension(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: how many vectors there are and the least and greatest length; null lengths for an empty store."""
    n = F.size(F.col(column))
    return vectors.where(F.col(column).isNotNull()).agg(F.count("*").alias("vectors"), F.min(n).alias("least"), F.max(n).alias("most"))


def check_dimension(vectors: DataFrame, expected: int | None = None) -> int:
    """The one length of all vectors; raises if there are several, none, an empty vector, or not the expected one."""
    r = dimension(vectors).first()
    if not r["vectors"] or not r["least"]:
        raise DimensionError("no vectors, or an empty one")
    if r["least"] != r["most"] or expected is not None and r["least"] != expected:
        raise DimensionError(f"vectors have {r['least']} to {r['most']} dimensions" + (f", {expected} were expected" if expected else ""))
    return r["least"]


def with_embeddings(chunks: DataFrame, known: DataFrame, embed) -> DataFrame:
    """``chunks`` with ``embedding``: the known one of the id, else what ``embed(missing chunks)`` gives."""
    cached = chunks.join(known.select("chunk_id", "embedding").dropDuplicates(["chunk_id"]), "chunk_id")
    missing = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti")
    return cached.unionByName(embed(missing))
