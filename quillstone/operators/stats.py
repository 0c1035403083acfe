"""Counts and status of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_project(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(F.count("*").alias("chunks"))


def totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, symbols (chunks with one), distinct paths."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("symbol") != "").alias("symbols"), F.count_distinct("path").alias("paths"))


def project_status(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project_id, path, chunks, last_indexed_at) of every project; one without chunks counts 0 and has no time."""
    live = chunks.groupBy("project_id").agg(F.count("*").alias("chunks"), F.max("indexed_at").alias("last_indexed_at"))
    return projects.select("project_id", "path").join(live, "project_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
