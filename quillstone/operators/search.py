"""Ranked retrieval over vectors: top k, path filters, boosts, de-duplication, several sources at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview, under
from ..functions.vectors import dot_with
from ..session import shared_checkpoint

#: Candidates fetched per result wanted, without and with a path prefix.
OVERFETCH, OVERFETCH_PATH = 2, 4
SYMBOL_BOOST, PATH_BOOST = 0.1, 0.05
DEFAULT_K = 10


def scored(vectors: DataFrame, query: Sequence[float], column: str = "embedding") -> DataFrame:
    """``vectors`` with ``score``, the dot product with ``query``; a null vector, or one of another length, gets no row."""
    v = F.col(column)
    return vectors.where(F.size(v) == len(query)).withColumn("score", F.round(dot_with(v, query), 6))


def top_k(rows: DataFrame, k: int = DEFAULT_K, key: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows; ties go to the lower key."""
    return rows.orderBy(F.desc("score"), F.asc(key)).limit(k if k > 0 else DEFAULT_K)


def boost(query: str, symbol: Column, path: Column) -> Column:
    """A symbol that contains the query counts more than a path that does; only one of them counts."""
    q = query.lower()
    return F.when(F.contains(F.lower(symbol), F.lit(q)), SYMBOL_BOOST).when(F.contains(F.lower(path), F.lit(q)), PATH_BOOST).otherwise(0.0)


def search(
    vectors: DataFrame,
    query: Sequence[float],
    text: str = "",
    k: int = DEFAULT_K,
    project: str | None = None,
    language: str | None = None,
    path: str | None = None,
    exact: bool = False,
    key: str = "chunk_id",
) -> DataFrame:
    """The ``k`` best chunks after the boosts.

    Project and language are filtered before ranking.  Candidates are the best 2k (4k with a path prefix), and the
    path is filtered among them, so fewer than ``k`` may come out; with ``exact`` the path is filtered first.
    """
    k = k if k > 0 else DEFAULT_K
    rows = vectors
    if project:
        rows = rows.where(F.col("project_id") == project)
    if language:
        rows = rows.where(F.col("language") == language)
    if path and exact:
        rows = rows.where(under(F.col("path"), F.lit(path)))
    rows = top_k(scored(rows, query), k * (OVERFETCH_PATH if path else OVERFETCH), key)
    if path and not exact:
        rows = rows.where(under(F.col("path"), F.lit(path)))
    if text:
        rows = rows.withColumn("score", F.round(F.col("score") + boost(text, F.coalesce("symbol", F.lit("")), F.coalesce("path", F.lit(""))), 6))
    return top_k(rows, k, key)


#: Queries, and vectors, that make one block: matrices of this many rows meet each other.
BLOCK = 4_096
#: Bytes of query blocks that are sent to all tasks; more meet the vectors partition by partition.
SENT_BYTES = 64 << 20


def blocks(rows: DataFrame, key: str, vector: str, prefix: str, block: int) -> DataFrame:
    """(<prefix>_keys, <prefix>_dim, <prefix>_matrix): the vectors as matrices of at most ``block`` rows, each of one length."""
    import numpy as np
    import pandas as pd

    names = [f"{prefix}_keys", f"{prefix}_dim", f"{prefix}_matrix"]

    def packed(batches):
        held: dict[int, tuple[list, list]] = {}

        def frame(dim):
            keys, parts = held.pop(dim)
            return pd.DataFrame([(keys, dim, np.array(parts, dtype=np.float64).tobytes())], columns=names)

        for pdf in batches:
            for k, v in zip(pdf[key], pdf[vector]):
                keys, parts = held.setdefault(len(v), ([], []))
                keys.append(k)
                parts.append(v)
                if len(keys) >= block:
                    yield frame(len(v))
        for dim in list(held):
            yield frame(dim)

    kind = dict(rows.dtypes)[key]
    return rows.where(F.size(vector) > 0).select(key, vector).mapInPandas(packed, f"{names[0]} array<{kind}>, {names[1]} int, {names[2]} binary")


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_K, block: int = BLOCK, query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries`` (query_id, query), with their rank.

    The stated query set meets every vector, both in blocks: a pair of blocks is one matrix product in a task, of which
    k rows per query leave it, never a row per pair.  Neither queries nor vectors pass the driver.
    """
    import numpy as np
    import pandas as pd

    schema = f"{query_key} {dict(queries.dtypes)[query_key]}, {key} {dict(vectors.dtypes)[key]}, score double"
    # the query blocks are written once: they meet every block of vectors
    asked = shared_checkpoint(vectors.sparkSession, blocks(queries, query_key, "query", "q", block))
    if (asked.agg(F.sum(F.octet_length("q_matrix")).alias("n")).first()["n"] or 0) <= SENT_BYTES:
        asked = F.broadcast(asked)
    given = blocks(vectors, key, "embedding", "v", block)

    def best(batches):
        for pdf in batches:
            for qk, qm, vk, vm, dim in zip(pdf["q_keys"], pdf["q_matrix"], pdf["v_keys"], pdf["v_matrix"], pdf["q_dim"]):
                names, keys = np.asarray(qk), np.asarray(vk)
                scores = np.round(np.frombuffer(vm).reshape(-1, dim) @ np.frombuffer(qm).reshape(-1, dim).T, 6)
                least = np.partition(scores, -k, axis=0)[-k] if len(keys) > k else np.full(len(names), -np.inf)
                row, col = np.nonzero(scores >= least)
                # of equal scores the lower key counts
                order = np.lexsort((keys[row], -scores[row, col], col))
                row, col = row[order], col[order]
                first = np.searchsorted(col, np.arange(len(names)))
                keep = np.arange(len(col)) - first[col] < k
                row, col = row[keep], col[keep]
                yield pd.DataFrame({query_key: names[col], key: keys[row], "score": scores[row, col]})

    found = given.crossJoin(asked).where("q_dim = v_dim").mapInPandas(best, schema)
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_path(hits: DataFrame) -> DataFrame:
    """The best hit of each path; ties go to the lower start line."""
    w = Window.partitionBy("path").orderBy(F.desc("score"), F.asc("start_line"))
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unified(legs: dict[str, DataFrame], k: int = DEFAULT_K) -> DataFrame:
    """The legs (code, docs, memory, in this order of precedence) as one ranked list.

    A row that several legs find (same path and lines) counts once, for the first of them.
    """
    columns = ["path", "start_line", "end_line", "score", "content"]
    rows = None
    for rank, (source, leg) in enumerate(legs.items()):
        part = leg.select(*columns).withColumn("source", F.lit(source)).withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("path", "start_line", "end_line").orderBy("_rank", F.desc("score"))
    once = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")
    return once.orderBy(F.desc("score"), "path", "start_line").limit(k if k > 0 else DEFAULT_K)


def memory_search(vectors: DataFrame, query: Sequence[float], k: int = DEFAULT_K, provider: str = "cascade", exact: bool = False) -> DataFrame:
    """The best hit of each remembered file, with a preview: 2k candidates, one per path, k of them; with ``exact`` all are candidates."""
    rows = vectors.where(F.col("project_id") == F.concat(F.lit("memory-"), F.lit(provider)))
    k = k if k > 0 else DEFAULT_K
    hits = scored(rows, query)
    hits = best_per_path(hits if exact else top_k(hits, k * OVERFETCH))
    return hits.withColumn("content", preview(F.col("content"))).orderBy(F.desc("score"), "path").limit(k)
