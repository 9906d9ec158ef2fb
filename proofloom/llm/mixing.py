"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, targets follow weights up to a cap with the excess shared
again, and each document is emitted floor(rate) times plus one more copy with a probability
of the fraction, decided by a hash of seed and document id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, word_count

# A table of at most so many sources is sent to every executor; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_sizes(docs: DataFrame, size: Column, source: str = "source") -> DataFrame:
    """``__source, source_size``: one row per source (null is a source of its own)."""
    return (docs.select(F.col(source).alias("__source"), size.alias("__size"))
            .groupBy("__source").agg(F.sum("__size").cast("long").alias("source_size")))


def cyclic_weights(sources: DataFrame, cycle: Sequence[float]) -> DataFrame:
    """``weight`` by place in code point order, null last, repeating ``cycle``.

    Works on one row per source.  Ranks are per first character, with a running count of
    the characters before, so no task sorts more than the sources that share one.
    """
    first = F.substring("__source", 1, 1)
    heads = sources.groupBy(first.alias("__head")).agg(F.count("*").alias("__n"))
    before = Window.orderBy(F.col("__head").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("__head", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__head").orderBy(F.col("__source").asc_nulls_last())
    ranked = sources.withColumn("__head", first).withColumn("__rank", F.row_number().over(inside) - 1)
    place = F.col("__rank") + F.col("__before")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return (ranked.alias("r").join(heads.alias("h"), F.col("r.__head").eqNullSafe(F.col("h.__head")))
            .select("__source", "source_size",
                    F.get(weights, F.pmod(place, F.lit(len(cycle))).cast("int")).alias("weight")))


def fill_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes dealt by weight, none above ``cap`` times its source.

    Water level: sources over the level's share stop at their cap and the rest is dealt anew
    until none is above.  Each round reads three sums over the sources, nothing else.
    """
    top = F.col("source_size") * F.lit(float(cap))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    amount, level, full = share * total, None, -1
    while True:
        over = F.lit(False) if level is None else top < F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(over, top)).alias("c"), F.sum(F.when(~over, F.col("weight"))).alias("w"),
                          F.count(F.when(over, 1)).alias("n")).first()
        if row.n == full:
            break
        full, level = row.n, (amount - (row.c or 0.0)) / row.w if row.w else float("inf")
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") > top, top)
                              .otherwise(F.lit(level) * F.col("weight")))


def plan_mix(docs: DataFrame, cycle: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
             seed: int = 7, size: Column | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Documents with ``size, source_size, target, copies``.

    Null or blank texts have size 0 and are planned like others; a null source is a source, last in
    order; a source without words has target 0 and copies 0.  Equal ids are decided alike, so
    repeated rows stay together.  Columns of these four names in the input are replaced.
    An empty table gives an empty plan.  ``cap`` bounds copies by its ceiling.
    """
    size = word_count(F.col("text")) if size is None else size
    docs = docs.drop("size", "source_size", "target", "copies") if size is None else docs
    sources = keep(source_sizes(docs, size, source), "sources")
    targets = keep(fill_targets(keep(cyclic_weights(sources, cycle), "weights"), share, cap), "targets").drop("weight")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    own = docs.withColumn("size", size).drop("source_size", "target", "copies")
    joined = own.join(targets, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
                               .cast("binary")), 1, 13)
    chance = F.conv(digits, 16, 10).cast("long") / F.lit(float(16 ** 13))
    return joined.withColumn("copies", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int"))


def emit_mix(planned: DataFrame) -> DataFrame:
    """The mix: every planned row ``copies`` times, with ``copy_no`` from 0."""
    numbered = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    return planned.withColumn("copy_no", F.explode(numbered))
