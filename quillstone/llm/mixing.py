"""Problem 8: mixing sources to target weights (capped water-filling).

A source's tokens times its most repeats cap what it can give.  Sources whose target exceeds the cap are clamped to it
and the rest of the weight is shared among the others in proportion to their targets, until no target exceeds a cap.
Each source then gives whole repetitions of all its documents and, for the fraction left, documents in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import few, shared_checkpoint
from .tokens import token_counts

SEED = 42
#: Classes of the seeded order per source; only the class in which the fraction ends is looked at document by document.
CLASSES = 4_096
#: Sources that targets may name: their totals come to the driver, one row each.
MOST_SOURCES = 100_000


def water_fill(sources: list[tuple[str, float, int, int]], total: float | None = None) -> dict[str, float]:
    """Tokens each source gives; ``sources`` are (name, target share, tokens it has, most repeats).

    ``total`` is the size of the mixture, by default what the sources hold; it shrinks to what the caps allow.
    Sources without tokens, repeats or share give nothing, and their weight goes to the others.
    """
    caps = {s: float(t) * r for s, w, t, r in sources if t > 0 and r > 0 and w > 0}
    weights = {s: w for s, w, *_ in sources if s in caps}
    left = float(sum(t for s, w, t, r in sources if s in caps)) if total is None else float(total)
    given: dict[str, float] = {}
    open_ = dict(weights)
    while open_:
        scale = left / sum(open_.values())
        over = [s for s, w in open_.items() if w * scale >= caps[s]]
        if not over:
            return given | {s: w * scale for s, w in open_.items()}
        for s in over:
            given[s] = caps[s]
            left -= caps[s]
            del open_[s]
        left = max(0.0, left)
    return given


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, tokenizers: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: (doc_id, source, tokens, copies) of every document that is taken at least once; copies never exceed the
    source's repeats.  shares: one row per source of ``targets`` with its target, what it holds and gives, and the
    share it reaches.  Documents of other or no sources, and documents without tokens, are left out.
    """
    spark = documents.sparkSession
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    sized = token_counts(documents.where(F.col("source").isNotNull()), ["doc_id", "source"], tokenizers).where("tokens > 0").join(few(wanted.select("source")), "source", "left_semi")
    order = F.xxhash64("doc_id", F.lit(seed))
    sized = shared_checkpoint(spark, sized.withColumn("class", F.pmod(order, F.lit(CLASSES)).cast("int")))
    held = sized.groupBy("source").agg(F.sum("tokens").alias("held"), F.count("*").alias("documents"))
    plan = wanted.join(held, "source", "left").fillna(0, ["held", "documents"]).limit(MOST_SOURCES + 1).collect()
    if len(plan) > MOST_SOURCES:
        raise ValueError(f"targets name more than {MOST_SOURCES} sources")
    given = water_fill([(r.source, r.target_share or 0.0, r.held, r.max_repeats or 0) for r in plan], total)
    rows = []
    for r in plan:
        tokens = given.get(r.source, 0.0)
        whole = min(int(tokens // r.held), r.max_repeats) if r.held else 0
        part = tokens - whole * r.held if r.held and whole < r.max_repeats else 0.0
        rows.append((r.source, whole, part))
    split = spark.createDataFrame(rows, "source string, whole int, part double")
    # tokens by source and class; the cut class is found on this small table, and documents are ranked only within it
    classes = sized.groupBy("source", "class").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.withColumn("before", before)
    placed = sized.join(few(split), "source").join(classes, ["source", "class"])
    rest = F.col("part") - F.col("before")
    sure = placed.where(rest >= F.col("n")).withColumn("extra", F.lit(1))
    edge = placed.where((rest < F.col("n")) & (rest > 0))
    upto = F.sum("tokens").over(Window.partitionBy("source", "class").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # a document is taken where at least half of it lies within the fraction
    edge = edge.withColumn("extra", (upto - F.col("tokens") / 2 <= rest).cast("int"))
    none = placed.where(rest <= 0).withColumn("extra", F.lit(0))
    every = sure.unionByName(edge).unionByName(none)
    mixture = every.withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    taken = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given"), F.max("copies").alias("most_copies"))
    all_ = wanted.join(held, "source", "left").join(taken, "source", "left").fillna(0, ["held", "documents", "given", "most_copies"])
    share = F.round(F.col("given") / F.greatest(F.sum("given").over(Window.partitionBy()), F.lit(1)), 6)
    shares = all_.select("source", "target_share", "max_repeats", "documents", "held", "given", "most_copies", share.alias("actual_share"))
    return mixture, shares


def invariants(documents: DataFrame, targets: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """One row of what must hold of a mixture, each a count of what breaks the rule (0).

    ``over_repeats``: documents taken more often than their source allows; ``strange``: documents of no named source;
    ``partial``: sources of which a document is taken twice more than another; ``off_share``: sources whose tokens differ
    from the water-filling by more than their longest document; ``unsummed``: 1 if the shares do not add up to 1.
    """
    spark = documents.sparkSession
    mixture, shares = mix(documents, targets, tokenizers=tokenizers)
    mixture, shares = shared_checkpoint(spark, mixture), shared_checkpoint(spark, shares)
    bad = mixture.join(shares.select("source", "max_repeats"), "source", "left").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_repeats"), F.count_if(F.col("max_repeats").isNull()).alias("strange"))
    rows = shares.collect()  # at most MOST_SOURCES
    longest = {r.source: r.longest for r in mixture.groupBy("source").agg(F.max("tokens").alias("longest")).collect()}
    given = water_fill([(r.source, r.target_share or 0.0, r.held, r.max_repeats or 0) for r in rows])
    off = sum(abs(r.given - given.get(r.source, 0.0)) > longest.get(r.source, 0) for r in rows)
    partial = mixture.groupBy("source").agg((F.max("copies") - F.min("copies") > 1).alias("p")).agg(F.count_if("p").alias("partial"))
    unsummed = int(abs(sum(r.actual_share for r in rows) - (1.0 if any(r.given for r in rows) else 0.0)) > 1e-4)
    return bad.join(partial).select("over_repeats", "strange", "partial", F.lit(off).cast("bigint").alias("off_share"), F.lit(unsummed).cast("bigint").alias("unsummed"))
