"""Ordered and joined work that survives one key owning a third of the rows.

A plain ``Window.partitionBy(user)`` sorts everything one user did in a single
task.  The helpers here cut each key into chunks that follow the order column,
work inside the chunks, and carry one summary row per chunk across the
boundary.  The summary is smaller than the input by the chunk size, so even the
busiest key leaves a small second step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import merged

CHUNK = "__chunk"
CARRY = "__carry"
SALT = "__salt"


def time_chunk(ts: Column, seconds: int) -> Column:
    """Chunk id of a timestamp: consecutive ranges of ``seconds``."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(seconds))


def id_chunk(number: Column, width: int) -> Column:
    """Chunk id of a unique number: at most ``width`` rows can share one."""
    return F.floor(number / F.lit(width))


def _carry_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                fields: Sequence[str], only_when: Column | None = None) -> DataFrame:
    """One row per (keys, chunk) holding the last ``fields`` of all earlier chunks."""
    packed = F.struct(*[F.col(f) for f in fields])
    value = packed if only_when is None else F.when(only_when, packed)
    at = F.struct(*[F.col(o) for o in order])
    if only_when is not None:
        at = F.when(only_when, at)
    tails = rows.groupBy(*keys, CHUNK).agg(F.max_by(value, at).alias("__tail"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return tails.select(*keys, CHUNK, F.last("__tail", ignorenulls=True).over(earlier).alias(CARRY))


def previous_row(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                 fields: Sequence[str], chunk: Column, prefix: str = "prev_") -> DataFrame:
    """``lag(field, 1)`` over (keys, order) for every field, as ``prev_<field>``.

    ``order`` must be a total order inside a key and ``chunk`` must never
    decrease along it.
    """
    rows = rows.withColumn(CHUNK, chunk)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    lagged = rows.withColumn("__lag", F.lag(F.struct(*fields)).over(inside))
    carry = _carry_last(rows, keys, order, fields)
    joined = lagged.join(merged(carry), [*keys, CHUNK], "left")
    before = F.coalesce("__lag", CARRY)
    return joined.select("*", *[before[f].alias(prefix + f) for f in fields]).drop(
        CHUNK, CARRY, "__lag")


def last_known(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
               fields: Sequence[str], when: Column, chunk: Column,
               prefix: str = "last_") -> DataFrame:
    """As-of join inside one stream: the newest row at or before this one where
    ``when`` holds, its ``fields`` attached as ``last_<field>`` (null if none)."""
    rows = rows.withColumn(CHUNK, chunk).withColumn("__is", F.coalesce(when, F.lit(False)))
    so_far = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    packed = F.when(F.col("__is"), F.struct(*fields))
    seen = rows.withColumn("__seen", F.last(packed, ignorenulls=True).over(so_far))
    carry = _carry_last(rows, keys, order, fields, F.col("__is"))
    joined = seen.join(carry, [*keys, CHUNK], "left")
    value = F.coalesce("__seen", CARRY)
    return joined.select("*", *[value[f].alias(prefix + f) for f in fields]).drop(
        CHUNK, CARRY, "__seen", "__is")


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                amount: Column, chunk: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``amount`` over (keys, order)."""
    rows = rows.withColumn(CHUNK, chunk).withColumn("__amount", amount)
    inside = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = rows.withColumn("__part", F.sum("__amount").over(inside))
    totals = rows.groupBy(*keys, CHUNK).agg(F.sum("__amount").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, CHUNK, F.sum("__total").over(earlier).alias(CARRY))
    return (part.join(carry, [*keys, CHUNK], "left")
            .withColumn(name, F.col("__part") + F.coalesce(F.col(CARRY), F.lit(0)))
            .drop(CHUNK, CARRY, "__amount", "__part"))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str],
                how: str = "inner", salts: int = 16, spread_on: Sequence[str] = ()) -> DataFrame:
    """Equi-join of a possibly hot side with a side unique on ``keys``.

    The big side is spread over ``salts`` by a hash of its own columns, so a
    recomputed task lands every row where it was before; the small side is
    repeated once per salt, and merged: planners do not see the repetition.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting the left side cannot serve a {how} join")
    source = list(spread_on) or [c for c in big.columns if c not in keys]
    salted = big.withColumn(SALT, F.pmod(F.xxhash64(*source), F.lit(salts)).cast("int"))
    repeated = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(merged(repeated), [*keys, SALT], how).drop(SALT)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  fields: Sequence[str] | None = None) -> DataFrame:
    """The row with the smallest ``order`` in each key, by map-side aggregation."""
    names = list(fields) if fields is not None else [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*names), F.struct(*order)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[n].alias(n) for n in names])


def top_n_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank_no") -> DataFrame:
    """First ``n`` rows of each key.  Spark limits every map task to ``n`` rows
    per key before the shuffle, so a hot key moves at most tasks x n rows."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)
