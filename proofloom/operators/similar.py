"""Name similarity as a join of names inside a scope, or over a positional q-gram index.

The score is the Ratcliff/Obershelp ratio of the standard library: twice the characters in matching blocks over all
characters.  Two names of la and lb characters that reach ``threshold`` t match in M >= t * (la + lb) / 2 characters, so

* their lengths differ by a factor of (2 - t) / t at most;
* the blocks keep their order, so a character moves by at most the unmatched ones before it;
* every block but the first costs an unmatched character, so at least 3 * M - la - lb - 1 pairs of neighbouring characters
  are shared.  Names too short for that bound share single characters, M of them.

Names of a scope meet each other there: a pair counts only where one scope holds both names, so names of other scopes add
nothing.  What two names can have in common is bounded by signs of their characters before a pair leaves the join, and by
their longest common subsequence before it is scored.  Scopes of more than ``LOOKED_THROUGH`` pairs are not looked through:
their distinct names are indexed once, whatever number of them they occur in, by their rarest q-grams (document frequencies
of these very names), split by length and position so that a common q-gram is many keys.  Only pairs that meet in the index
are scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import merged, stored

SLACK = 1e-9
# Pairs of one scope that a task looks through; how many parts of names' scopes there are for each core.
LOOKED_THROUGH, PARTS_PER_CORE = 1 << 24, 4
# Signs of a name: a bit for each place of a character among its equals, up to the sixth, in words of 64.
KINDS, PLACES, WORDS = 37, 6, 4


def _ratio_at_least(threshold: float) -> Callable[[str, str], float]:
    """The ratio of two names, or 0 where their longest common subsequence shows that it stays below ``threshold``.

    Not symmetric: the first name is the first sequence.  Equal names give 1, either empty 0.  Matching blocks keep their order, so they are a common subsequence.
    """
    @lru_cache(1 << 12)
    def places(name: str) -> dict[str, int]:
        at: dict[str, int] = {}
        for i, c in enumerate(name):
            at[c] = at.get(c, 0) | 1 << i
        return at

    @lru_cache(1 << 16)
    def ratio(x: str, y: str) -> float:
        if x == y or not x or not y:
            return float(x == y != "")
        # A clear bit of ``free`` is a character of x in the subsequence so far.
        at, whole = places(x), (1 << len(x)) - 1
        free = whole
        for c in y:
            used = free & at.get(c, 0)
            free = (free + used | free - used) & whole
        if 2 * (len(x) - free.bit_count()) < threshold * (len(x) + len(y)) - SLACK:
            return 0.0
        return SequenceMatcher(None, x, y).ratio()

    return ratio


def reaching_ratio(a: Column, b: Column, threshold: float) -> Column:
    """The ratio where it reaches the threshold; anything below it elsewhere."""
    @F.pandas_udf(T.DoubleType())
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        own = _ratio_at_least(threshold)
        return pd.Series([own(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratios(a, b)


@F.pandas_udf(T.ArrayType(T.LongType()))
def signs(names: pd.Series) -> pd.Series:
    """The characters of a name as bits, ``WORDS`` longs: one that another name lacks stands for a character unmatched by it."""
    def of(name: str) -> list[int]:
        seen: dict[str, int] = {}
        found = 0
        for c in name:
            k = seen[c] = seen.get(c, -1) + 1
            found |= 1 << min(k, PLACES - 1) * KINDS + ord(c) % KINDS
        words = [found >> 64 * i & 0xFFFFFFFFFFFFFFFF for i in range(WORDS)]
        return [w - (1 << 64) if w >> 63 else w for w in words]

    return pd.Series([of(n) for n in names])


def reach(threshold: float) -> float:
    """How many times as long the longer of two names can be."""
    return (2 - threshold) / threshold


def shared_at_least(length: Column, q: int, threshold: float) -> Column:
    """How many q-grams a name of this length shares with any name that reaches the threshold."""
    other = F.ceil(length / F.lit(reach(threshold)) - SLACK)
    both = length + other
    least = both * (threshold / 2) if q == 1 else both * (1.5 * threshold - 1) - 1
    return F.ceil(least - SLACK).cast("int")


def longest_short(threshold: float) -> int | None:
    """Names up to this length may share no pair of neighbouring characters; None if that holds for every length."""
    gain = 1.5 * threshold - 1
    if gain <= SLACK:
        return None
    length = 1
    while (length + math.ceil(length / reach(threshold) - SLACK)) * gain - 1 <= SLACK:
        length += 1
    return length - 1


def _band(length: Column, threshold: float) -> Column:
    """Lengths in ranges as wide as the reach or wider, so partners lie in the same range or a neighbouring one."""
    return F.floor(F.log(length.cast("double")) / math.log(_range(threshold)) + SLACK).cast("int")


def _range(threshold: float) -> float:
    return max(reach(threshold), 1.05)


def _width(band: Column, threshold: float) -> Column:
    """Places in one bucket: as many as a character can move between names of this range and its neighbours."""
    top = F.pow(F.lit(_range(threshold)), band + 2)
    return F.greatest(F.ceil(top * (1 - 1 / reach(threshold))), F.lit(1)).cast("int")


def _grams(q: int) -> Column:
    """All runs of ``q`` characters of a name of at least so many, with their places."""
    return F.transform(F.sequence(F.lit(1), F.length("name") - (q - 1)),
                       lambda i: F.struct(F.substring(F.col("name"), i, F.lit(q)).alias("gram"), i.alias("pos")))


def _postings(names: DataFrame, q: int, threshold: float, frequency: DataFrame) -> DataFrame:
    """``name, length, band`` once per place of one of its rare q-grams: ``gram, pos``."""
    length = F.length("name")
    grams = names.filter(length >= q).select("name", F.explode(_grams(q)).alias("g"))
    # A row holds the q-grams of one name.
    ranked = (grams.select("name", "g.gram", "g.pos").join(frequency, "gram").groupBy("name")
              .agg(F.sort_array(F.collect_list(F.struct("df", "gram", "pos"))).alias("all")))
    prefix = F.slice("all", 1, F.greatest(F.size("all") - shared_at_least(length, q, threshold) + 1, F.lit(0)))
    rare = F.array_distinct(F.transform(prefix, lambda g: g["gram"]))
    # All places of a rare q-gram count: which of them matches is not known.
    placed = (ranked.withColumn("rare", rare).select("name", F.explode(F.filter("all", lambda g: F.array_contains("rare", g["gram"]))).alias("g")))
    return placed.select("name", length.alias("length"), _band(length, threshold).alias("band"), "g.gram", "g.pos")


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct ``left_key, right_key`` of two tables of distinct names (``name``) that may reach the threshold.

    No pair that reaches it is left out; equal and empty names are.
    """
    short = longest_short(threshold)
    sides = [left.filter("name <> ''"), right.filter("name <> ''")]
    length = F.length("name")
    if short is None:
        parts = [(1, sides, None)]
    else:
        near = [s.filter(length <= math.floor(short * reach(threshold) + SLACK)) for s in sides]
        parts = [(2, [s.filter(length > short) for s in sides], None), (1, near, short)]
    found = []
    for q, (a, b), only in parts:
        frequency = (a.unionByName(b).filter(F.length("name") >= q)
                     .select(F.explode(F.array_distinct(F.transform(_grams(q), lambda g: g["gram"]))).alias("gram"))
                     .groupBy("gram").agg(F.count("*").alias("df")))
        probes = (_postings(a, q, threshold, frequency)
                  .select("name", "length", "gram", "pos", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"))
                  .withColumn("at", F.floor(F.col("pos") / _width(F.col("band"), threshold)))
                  .select(F.col("name").alias("left_key"), F.col("length").alias("la"), "gram", "band", F.col("pos").alias("pa"),
                          F.explode(F.array(*[F.col("at") + d for d in (-1, 0, 1)])).alias("bucket")))
        index = (_postings(b, q, threshold, frequency)
                 .select(F.col("name").alias("right_key"), F.col("length").alias("lb"), "gram", "band", F.col("pos").alias("pb"),
                         F.floor(F.col("pos") / _width(F.col("band"), threshold)).alias("bucket")))
        matched = F.ceil((F.col("la") + F.col("lb")) * (threshold / 2) - SLACK)
        moved = F.col("pa") - F.col("pb")
        fits = ((F.col("left_key") != F.col("right_key")) & (matched <= F.least("la", "lb"))
                & (moved <= F.col("la") - matched) & (-moved <= F.col("lb") - matched))
        if only is not None:
            fits &= F.least("la", "lb") <= only
        found.append(probes.join(index, ["gram", "band", "bucket"]).filter(fits).select("left_key", "right_key"))
    return (found[0] if len(found) == 1 else found[0].unionByName(found[1])).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``left_key, right_key, ratio`` of all pairs of two tables of distinct names (``name``) that reach the threshold."""
    scored = (candidate_pairs(left, right, threshold).withColumn("ratio", reaching_ratio(F.col("left_key"), F.col("right_key"), threshold))
              .filter(F.col("ratio") >= threshold))
    same = (left.filter("name <> ''").join(right, "name", "left_semi")
            .select(F.col("name").alias("left_key"), F.col("name").alias("right_key"), F.lit(1.0).alias("ratio")))
    return scored.unionByName(same)


def scoped_pairs(left: DataFrame, right: DataFrame, scope: Sequence[str], threshold: float) -> DataFrame:
    """``scope, left_key, right_key, ratio`` of all pairs of names of one scope that reach the threshold.

    ``left`` (scope, left_key) and ``right`` (scope, right_key) are distinct.  A scope's pairs are looked through in one task.
    """
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_CORE * spark.sparkContext.defaultParallelism)

    # Dealt by number: parts of few bytes hold many pairs, so small ones are not put together.
    def side(df: DataFrame, key: str, mark: str) -> DataFrame:
        held = df.repartition(parts, *scope).withColumn("__s", signs(key))
        return held.select(*scope, key, F.length(key).alias(f"{mark}n"), *[F.col("__s")[i].alias(f"{mark}{i}") for i in range(WORDS)])

    def lacking(mine: str, other: str) -> Column:
        bits = [F.bit_count(F.col(f"{mine}{i}").bitwiseAND(F.bitwise_not(F.col(f"{other}{i}")))) for i in range(WORDS)]
        return bits[0] + bits[1] + bits[2] + bits[3]

    both = side(left, "left_key", "__a").join(merged(side(right, "right_key", "__b")), list(scope))
    matched = F.ceil((F.col("__an") + F.col("__bn")) * (threshold / 2) - SLACK)
    met = both.filter((matched <= F.least("__an", "__bn")) & (lacking("__a", "__b") <= F.col("__an") - matched)
                      & (lacking("__b", "__a") <= F.col("__bn") - matched)).select(*scope, "left_key", "right_key")
    return met.withColumn("ratio", reaching_ratio(F.col("left_key"), F.col("right_key"), threshold)).filter(F.col("ratio") >= threshold)


def similar_names(left: DataFrame, right: DataFrame, scope: Sequence[str], threshold: float, most: int = LOOKED_THROUGH) -> DataFrame:
    """Pairs (scope, left_key, right_key, ratio) with ratio >= ``threshold``.

    Both inputs hold (scope, key).  Scopes of up to ``most`` pairs are looked through.  The names of all others are matched
    over these scopes and scored once; the pairs then meet the scopes that hold both names, by joins that are unique on one
    side.
    """
    scope = list(scope)
    a = left.select(*scope, F.col("key").alias("left_key")).distinct().filter(F.col("left_key") != "")
    b = right.select(*scope, F.col("key").alias("right_key")).distinct().filter(F.col("right_key") != "")
    counts = [side.groupBy(*scope).agg(F.count("*").alias(n)) for side, n in ((a, "__na"), (b, "__nb"))]
    sizes = stored(counts[0].join(merged(counts[1]), scope), "scope-sizes")
    large = sizes.filter(F.col("__na").cast("double") * F.col("__nb") > most).select(*scope)
    small = sizes.filter(F.col("__na").cast("double") * F.col("__nb") <= most).select(*scope)
    near = scoped_pairs(a.join(merged(small), scope, "left_semi"), b.join(merged(small), scope, "left_semi"), scope, threshold)
    if large.isEmpty():
        return near
    a, b = a.join(merged(large), scope, "left_semi"), b.join(merged(large), scope, "left_semi")
    # The index reads the names several times.
    names = [stored(side.select(F.col(key).alias("name")).distinct(), "names") for side, key in ((a, "left_key"), (b, "right_key"))]
    pairs = similar_pairs(*names, threshold)
    far = a.join(pairs, "left_key").join(b, [*scope, "right_key"])
    return near.unionByName(far.select(*scope, "left_key", "right_key", "ratio"))
