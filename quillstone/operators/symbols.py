"""Symbol lookup: exact, by part of the name, by meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import equal_fold

LOCATION = ["project_id", "path", "language", "symbol", "signature", "start_line", "end_line"]


def locations(chunks: DataFrame) -> DataFrame:
    """One row per chunk with a symbol, and the key it is found by."""
    return chunks.where(F.col("symbol") != "").select(*LOCATION).withColumn("symbol_key", F.lower("symbol"))


#: Places a row of the nested index holds at most.
BLOCK = 1_000


def symbol_index(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(symbol_key, block, places, locations): the places of each symbol, in blocks of about ``block`` at most.

    Most symbols are one row.  One that a third of all chunks share is spread over as many rows as it takes, so no list
    and no task grows with it.
    """
    rows = locations(chunks)
    counts = rows.groupBy("symbol_key").agg(F.ceil(F.count("*") / block).alias("_blocks")).where("_blocks > 1")
    spread = rows.join(counts, "symbol_key", "left")
    number = F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("path", "start_line"), F.col("_blocks"))).cast("int")
    place = F.struct("path", "start_line", "end_line", "symbol")
    return spread.groupBy("symbol_key", number.alias("block")).agg(F.count("*").alias("places"), F.sort_array(F.collect_list(place)).alias("locations"))


def exact(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("symbol_key") == name.lower())


def fuzzy(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.contains("symbol_key", F.lit(name.lower())))


def find_symbol(symbols: DataFrame, name: str, project: str | None = None, language: str | None = None, semantic: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Exact matches; if there are none anywhere, names that contain ``name``; then project and language are filtered.

    The choice comes before the filter: an exact match in another project keeps partial ones out.  If nothing is left,
    ``semantic("function or type named ...")`` is asked and its rows are kept whose symbol is or contains the name.
    One plan does the choice: the rows of the better class are kept, the class being a minimum over all candidates.
    """
    ranked = fuzzy(symbols, name).withColumn("_class", F.when(F.col("symbol_key") == name.lower(), 0).otherwise(1))
    best = ranked.agg(F.min("_class").alias("_best"))
    rows = ranked.join(F.broadcast(best), F.col("_class") == F.col("_best")).drop("_class", "_best")
    if project:
        rows = rows.where(F.col("project_id") == project)
    if language:
        rows = rows.where(equal_fold(F.col("language"), F.lit(language)))
    rows = rows.select(*LOCATION).withColumn("score", F.lit(1.0))
    if semantic is not None and rows.isEmpty():
        near = semantic(f"function or type named {name}")
        rows = near.where(F.contains(F.lower("symbol"), F.lit(name.lower()))).select(*LOCATION).withColumn("score", F.lit(1.0))
    return rows.orderBy("path", "start_line")
