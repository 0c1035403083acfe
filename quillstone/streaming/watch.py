"""Changes as a stream: debounced bursts of events, and the index that follows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WATCHED = ("write", "create", "rename", "remove")


def debounce(events: DataFrame, gap: str = "2 seconds", key: str | Column = "root", ts: str = "ts", path: str = "path", delay: str | None = None) -> DataFrame:
    """(key, start, end, events, paths): bursts of events of a key with no pause longer than ``gap``; each path once.

    Works on a table and on a stream; a stream gets a watermark of ``delay``.  An event exactly ``gap`` after the last
    still belongs to the burst.  A window over all keys does not stream, so there is always a key.
    """
    k = F.col(key) if isinstance(key, str) else key
    rows = events.select(k.alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(path).alias("path"))
    if delay:
        rows = rows.withWatermark("ts", delay)
    bursts = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sort_array(F.collect_set("path")).alias("paths"))
    return bursts.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "paths")


def follow(changes: DataFrame, read: Callable[[DataFrame], DataFrame], index, checkpoint: str, every: str = "5 seconds", projects: Callable[[], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Keeps ``index`` in line with a stream of changed paths (project_id, path).

    ``projects()`` gives the rules; it is asked for each micro-batch, so that changed rules hold from the next one on.
    Each micro-batch is made distinct, ``read(paths)`` gives the rows of the files that are there, and the index is
    updated with them; paths without a file leave it.  A batch that is run again gives the same index.
    """

    def batch(rows: DataFrame, _: int) -> None:
        paths = rows.select("project_id", "path").distinct()
        index.update_paths(paths, read(paths), projects() if projects else None)

    options = trigger or {"processingTime": every}
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**options).start()


def every(spark: SparkSession, act: Callable[[], object], checkpoint: str, period: str = "5 minutes") -> StreamingQuery:
    """Runs ``act`` once at the start and then every ``period``, until the query is stopped: a snapshot of the files against the
    index (``lambda: index.update(scan(...))``), a memory against its notes (``engine.sync_memory``).  What it does must
    be the same when done again, as these are."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda rows, n: act() and None).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()


def distinct_until_changed(states: DataFrame, order: str = "updated_at", key: str = "job_id") -> DataFrame:
    """The states of a job that differ from the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    body = F.to_json(F.struct(*(c for c in states.columns if c not in (order, key))))
    return states.withColumn("_b", body).withColumn("_p", F.lag("_b").over(w)).where(~F.col("_b").eqNullSafe(F.col("_p"))).drop("_b", "_p")
