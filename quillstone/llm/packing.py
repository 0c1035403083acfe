"""Problem 7: filling containers of fixed capacity with documents (sum-of-squares packing).

Documents arrive online; ``levels[h]`` counts the open containers filled to ``h``.  A document of size ``s`` goes where
the sum of squares of these counts grows least, among the open containers it fits into and a new one.  The corpus is
packed in shards of bounded size, each in one task on sizes alone; texts are not moved.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .common import map_rows
from .tokens import token_counts

CAPACITY = 2_048
#: Tokens of a shard; its few containers that stay open are all the space that sharding costs (README has figures).
SHARD_TOKENS = 8_000_000
#: Shards that a task packs one after another, on a corpus of many.
SHARDS_PER_TASK = 64


class SumOfSquares:
    """Online packing into containers of ``capacity``; ``place(size)`` gives the number of the container."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> int:
        if not 0 < size <= self.capacity:
            raise ValueError("a size must lie between 1 and the capacity")
        top = self.capacity - size
        n = self.levels
        # growth of the sum of squares when a container at level h goes to level h + size; a full one counts no more
        growth = 2 * n[size : self.capacity + 1] + 1
        growth[top] = 0
        growth[1:] += 1 - 2 * n[1 : top + 1]
        usable = n[: top + 1] > 0
        usable[0] = True
        growth = np.where(usable, growth, np.iinfo(np.int64).max)
        # of equal growth the fullest container is taken
        h = top - int(np.argmin(growth[::-1]))
        if h:
            bin_ = self.open[h].pop()
            n[h] -= 1
        else:
            bin_ = self.made
            self.made += 1
        if h + size < self.capacity:
            n[h + size] += 1
            self.open.setdefault(h + size, []).append(bin_)
        return bin_


PLACED = "shard int, container int, doc_id bigint, piece int, token_start bigint, token_end bigint"


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str | None = None) -> DataFrame:
    """(container_id, doc_id, piece, token_start, token_end): where the tokens of each document lie.

    Only a document above the capacity is split, into full pieces and a rest.  A null or empty text takes no space and
    gives no row; documents with equal ids are placed each.
    """
    spark = documents.sparkSession
    sizes = shared_checkpoint(spark, token_counts(documents, ["doc_id"], tokenizers).where("tokens > 0"))
    total = sizes.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total / SHARD_TOKENS))
    # a shard is a hash class of documents, so no source or project fills one; the order in it is seeded by the id
    # a task packs several shards one after another, as many as there are a core's worth of
    tasks = min(shards, max(spark.sparkContext.defaultParallelism, math.ceil(shards / SHARDS_PER_TASK)))
    keyed = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(tasks, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", F.lit(7)), "doc_id")

    def make():
        packers: dict[int, SumOfSquares] = {}

        def row(shard, doc_id, tokens):
            # rows come sorted by shard: a packer ends when the next shard begins
            if shard not in packers:
                packers.clear()
                packers[shard] = SumOfSquares(capacity)
            packer = packers[shard]
            for k, start in enumerate(range(0, tokens, capacity)):
                end = min(tokens, start + capacity)
                yield shard, packer.place(end - start), doc_id, k, start, end

        return row

    placed = map_rows(keyed, ["shard", "doc_id", "tokens"], PLACED, make)
    return placed.select((F.col("shard").cast("bigint") * F.lit(1 << 32) + F.col("container")).alias("container_id"), "doc_id", "piece", "token_start", "token_end")


def containers(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, items, tokens, unused) of each container."""
    tokens = F.sum(F.col("token_end") - F.col("token_start"))
    return placed.groupBy("container_id").agg(F.count("*").alias("items"), tokens.alias("tokens"), (F.lit(capacity) - tokens).alias("unused"))


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the space that is filled (1.0 of an empty corpus)."""
    each = containers(placed, capacity)
    n, t = F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))
    return each.agg(n.alias("containers"), t.alias("tokens"), F.coalesce(F.round(F.try_divide(t, n * capacity), 6), F.lit(1.0)).alias("filled"))


def invariants(documents: DataFrame, capacity: int = CAPACITY, tokenizers: str | None = None) -> DataFrame:
    """One row of what must hold of a packing: documents placed, and how often a rule is broken (0 each).

    ``lost_tokens``: tokens of the documents less those placed; ``gaps``: pieces that do not begin where the one before
    ended; ``overfull``: containers above the capacity; ``split``: documents within the capacity in several pieces.
    """
    placed = shared_checkpoint(documents.sparkSession, pack(documents, capacity, tokenizers))
    sizes = token_counts(documents, ["doc_id"], tokenizers).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("had"))
    per = placed.groupBy("doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"), F.max("token_end").alias("end"), F.count("*").alias("pieces"), F.count_if(F.col("piece") == 0).alias("copies"))
    by_doc = per.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("placed"), F.count_if(F.col("n") != F.col("end") * F.col("copies")).alias("gaps"), F.count_if((F.col("end") <= capacity) & (F.col("pieces") > F.col("copies"))).alias("split"))
    over = containers(placed, capacity).agg(F.count_if(F.col("unused") < 0).alias("overfull"))
    return by_doc.join(sizes).join(over).select("documents", (F.col("had") - F.col("placed")).alias("lost_tokens"), "gaps", "split", "overfull")
