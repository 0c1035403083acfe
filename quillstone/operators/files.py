"""Operators on a table of files (path, rel_path, content, mod_time): grep, line ranges, listings, trees, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glob import glob_regex
from ..functions.text import line_range, lines, under

#: Files above this size, in bytes, are not searched unless the caller lifts the limit.
GREP_BYTES = 1 << 20
GREP_K, TREE_DEPTH, RECENT_MINUTES = 20, 3, 60


def grep(files: DataFrame, query: str, regex: bool = False, root: str | None = None, most_bytes: int | None = GREP_BYTES) -> DataFrame:
    """(path, line, content) of each line that holds ``query``, or that the expression ``query`` matches.

    Case counts.  A text with a zero character in its first 512, or above ``most_bytes`` (None: no limit), is not
    searched.  The lines are filtered before they leave the array, so only matches are made rows.
    """
    rows = files.where(F.col("content").isNotNull() & ~F.contains(F.left("content", F.lit(512)), F.lit("\0")))
    if most_bytes is not None:
        rows = rows.where(F.octet_length("content") <= most_bytes)
    if root:
        rows = rows.where(under(F.col("path"), F.lit(root)))
    if not regex:
        rows = rows.where(F.contains("content", F.lit(query)))

    def hit(text: Column) -> Column:
        return text.rlike(f"(?d){query}") if regex else F.contains(text, F.lit(query))

    numbered = F.transform(lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("content")))
    found = rows.select("path", F.explode(F.filter(numbered, lambda x: hit(x["content"]))).alias("m"))
    # a file that was delivered again gives its matches once; only matches are moved for that
    return found.select("path", "m.line", "m.content").distinct()


def grep_top(files: DataFrame, query: str, k: int = GREP_K, regex: bool = False, root: str | None = None, most_bytes: int | None = GREP_BYTES) -> DataFrame:
    """The first ``k`` matches in order of path and line."""
    return grep(files, query, regex, root, most_bytes).orderBy("path", "line").limit(k if k > 0 else GREP_K)


def context(files: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """(path, content) with the lines asked for; files shorter than ``start`` give no row."""
    part = line_range(F.col("content"), F.lit(start), F.lit(end))
    return files.select("path", part.alias("content")).where(F.col("content").isNotNull()).distinct()


def listing(files: DataFrame, pattern: str = "*", directories: bool = False) -> DataFrame:
    """Paths whose place below the root matches ``pattern``; with ``directories`` those of directories too."""
    rx = glob_regex(pattern or "*")
    found = files.where(F.col("rel_path").rlike(rx)).select("path", F.lit("file").alias("type"))
    if directories:
        dirs = parents(files).where(F.col("rel_path").rlike(rx)).select("path", F.lit("dir").alias("type"))
        found = found.unionByName(dirs)
    return found.distinct()


def parents(files: DataFrame) -> DataFrame:
    """(root, rel_path, path) of every directory above a file, below its root."""
    parts = F.split("rel_path", "/")
    root = F.expr("left(path, greatest(length(path) - length(rel_path) - 1, 0))")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.where(F.contains("rel_path", F.lit("/"))).select(root.alias("root"), F.explode(up).alias("rel_path")).distinct()
    return rows.withColumn("path", F.concat_ws("/", "root", "rel_path"))


def tree(files: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(root, path, parent, depth, type) of the entries at most ``depth`` levels below their root.

    Spark has no recursive type: the tree is flat rows, and children are found by ``parent``.
    """
    depth = depth if depth > 0 else TREE_DEPTH
    root = F.expr("left(path, greatest(length(path) - length(rel_path) - 1, 0))")
    leaves = files.select(root.alias("root"), "rel_path").distinct().withColumn("type", F.lit("file"))
    nodes = leaves.unionByName(parents(files).select("root", "rel_path").withColumn("type", F.lit("dir")))
    parent = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    level = F.size(F.split("rel_path", "/"))
    return nodes.select("root", F.col("rel_path").alias("path"), parent.alias("parent"), level.alias("depth"), "type").where(F.col("depth") <= depth)


def recent(files: DataFrame, now: Column, minutes: int = RECENT_MINUTES) -> DataFrame:
    """(path, mod_time as text) of the files changed less than ``minutes`` before ``now``."""
    span = F.make_dt_interval(mins=F.lit(minutes if minutes > 0 else RECENT_MINUTES))
    rows = files.where(F.col("mod_time") > now - span)
    return rows.groupBy("path").agg(F.date_format(F.max("mod_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mod_time"))
