"""Nearest vectors by blocks: a query block meets a candidate block in one task.

Two searches share the grid.  ``nearest_by_tiles`` filters by int8 products with error bounds, ``top_by_segments`` by
segment means and deviations from coarse to fine; both compute survivors exactly, so their results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .integers import clamped, exact_products, fits_long

QUERY_BLOCK, CANDIDATE_BLOCK, SUB_BLOCK, QUERY_STEP = 4096, 8192, 1024, 64
Heaps = list[list[tuple]]


def usable(rows: DataFrame, vec: str, nonzero: bool) -> DataFrame:
    """Rows with an id and a vector of finite components, not all zero if so asked."""
    x = F.col(vec)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(x.isNotNull() & F.coalesce(fine, F.lit(False))
                       & ((F.exists(x, lambda v: v != 0)) if nonzero else F.lit(True)))


def _search(rows: DataFrame, query: Column, k: int, tile: Callable, kind: str) -> DataFrame:
    """``query_id, rank, vec_id, score`` over ``rows(vec_id, v)``; ``tile`` fills a query block's heaps.

    Of equal vectors only the k+1 smallest ids can be among a query's k nearest, so each
    distinct vector is a candidate k+1 times at most, however often it occurs.
    """
    rows = rows.filter("vec_id is not null").distinct()
    same = Window.partitionBy("v").orderBy("vec_id")
    few = keep(rows.withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= k + 1).drop("__n"), "candidates")
    asked = keep(rows.filter(query), "queries")
    nc, nq = max(1, -(-few.count() // CANDIDATE_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    place = F.xxhash64("vec_id")

    def dealt(df, is_query, own, n_own, other, n_other):
        return (df.withColumn(own, F.pmod(place, F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
                .select(F.size("v").alias("dim"), "qb", "cb", F.lit(is_query).alias("asks"), "vec_id", "v"))

    both = dealt(asked, True, "qb", nq, "cb", nc).unionByName(dealt(few, False, "cb", nc, "qb", nq))

    def run(table: pa.Table) -> pa.Table:
        def side(asks):
            part = table.filter(pa.compute.equal(table.column("asks"), asks))
            ids = part.column("vec_id").to_numpy()
            flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return ids, flat.reshape(len(ids), table.column("dim")[0].as_py())

        (qi, q), (ci, c) = side(True), side(False)
        heaps: Heaps = [[] for _ in qi]
        if q.shape[1] and len(qi) and len(ci):
            tile(qi, q, ci, c, heaps, k)
        elif len(ci):  # vectors without components: every score is 0
            heaps = [heapq.nsmallest(k, ((0, x) for x in ci.tolist() if x != i)) for i in qi.tolist()]
        return pa.table({"query_id": pa.array([i for i, h in zip(qi.tolist(), heaps) for _ in h], pa.int64()),
                         "vec_id": pa.array([x for h in heaps for _, x in h], pa.int64()),
                         "score": pa.array([clamped(-s) if kind == "long" else -s for h in heaps for s, _ in h],
                                           pa.int64() if kind == "long" else pa.float64())})

    met = both.groupBy("dim", "qb", "cb").applyInArrow(run, f"query_id long, vec_id long, score {kind}").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _push(heaps: Heaps, k: int, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Merges found (query place, id, score) into the queries' heaps of (-score, id)."""
    order = np.argsort(at, kind="stable")
    at, ids, scores = at[order], ids[order].tolist(), (-scores[order]).tolist()
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist() + [len(at)] if len(at) else [0]
    for a, b in zip(starts[:-1], starts[1:]):
        i = int(at[a])
        heaps[i] = heapq.nsmallest(k, heaps[i] + list(zip(scores[a:b], ids[a:b])))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, step, norm of the vector, of its int8 form and of the difference."""
    step = np.abs(x).max(axis=1) / 127
    step[step == 0] = 1
    q = np.rint(x / step[:, None]).astype(np.int8)
    back = q * step[:, None]
    return q, step, np.linalg.norm(x, axis=1), np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def _int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows.  Sums of 1,024 products stay below 2**24, where float32 holds every integer."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], 1024):
        out += a[:, d:d + 1024].astype(np.float32) @ b[:, d:d + 1024].astype(np.float32).T
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise double inner products, components added in order, so equal rows give equal sums."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def int8_tile(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, heaps: Heaps, k: int) -> None:
    """|<x,y> - <x',y'>| <= |x - x'| |y'| + |x| |y - y'| bounds what rounding to int8 can hide."""
    q, c = q.astype(np.float64), c.astype(np.float64)
    q8, qs, qn, qb, qe = _quantised(q)
    for s in range(0, len(ci), SUB_BLOCK):
        ids, y = ci[s:s + SUB_BLOCK], c[s:s + SUB_BLOCK]
        c8, cs, cn, cb, ce = _quantised(y)
        about = _int8_products(q8, c8) * qs[:, None] * cs[None, :]
        slack = np.outer(qe, cb) + np.outer(qn, ce) + 1e-9 * np.outer(qn, cn)
        own = qi[:, None] == ids[None, :]
        least = np.where(own, -np.inf, about - slack)
        floor = np.array([-h[-1][0] if len(h) == k else -np.inf for h in heaps])
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(least, len(ids) - k, axis=1)[:, len(ids) - k])
        at, to = np.nonzero((about + slack >= floor[:, None]) & ~own)
        for p in range(0, len(at), 1 << 16):
            i, j = at[p:p + (1 << 16)], to[p:p + (1 << 16)]
            _push(heaps, k, i, ids[j], inner_products(q[i], y[j]))


def segment_levels(x: np.ndarray) -> list[np.ndarray]:
    """Per level 1, 2, 4, ... segments: means and deviations, each times the root of the segment's length.

    The squared distance of two such rows is a lower bound of that of the vectors; finer levels are closer.
    """
    dim, levels, m = x.shape[1], [], 1
    while m <= max(1, dim // 2):
        edges = [dim * i // m for i in range(m + 1)]
        parts = [x[:, a:b] for a, b in zip(edges, edges[1:])]
        roots = [np.sqrt(b - a) for a, b in zip(edges, edges[1:])]
        levels.append(np.stack([p.mean(axis=1) * r for p, r in zip(parts, roots)]
                               + [p.std(axis=1) * r for p, r in zip(parts, roots)], axis=1))
        m *= 2
    return levels


def _pair_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products of whole numbers: as longs where no sum can leave one, else as Python integers."""
    if fits_long(a, b):
        return np.einsum("ij,ij->i", a, b)
    return (a.astype(object) * b.astype(object)).sum(axis=1)


def segment_tile(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, heaps: Heaps, k: int) -> None:
    """A lower bound of the squared distance gives an upper bound of the product: 2<x,y> = |x|^2 + |y|^2 - d^2.

    A few queries at a time meet all candidates; a level's distances are one matrix product.  Levels end when one rules
    out less than a tenth, and what is left is multiplied exactly.
    """
    ql, cl = segment_levels(q.astype(np.float64)), segment_levels(c.astype(np.float64))
    q2, c2 = (q.astype(np.float64) ** 2).sum(axis=1), (c.astype(np.float64) ** 2).sum(axis=1)
    for s in range(0, len(qi), QUERY_STEP):
        own = slice(s, s + QUERY_STEP)
        both = q2[own, None] + c2[None, :]
        slack = 1e-6 + 2e-9 * both

        def bound(level: int) -> np.ndarray:
            x, y = ql[level][own], cl[level]
            d2 = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
            return np.where(other, (both - d2) / 2 + slack, -np.inf)

        other = qi[own, None] != ci[None, :]
        floor = np.array([-heaps[i][-1][0] if len(heaps[i]) == k else -np.inf for i in range(s, s + len(other))], np.float64)
        if len(ci) > k:  # some likely ones first, for a floor to measure the others against
            likely = np.argpartition(-bound(min(2, len(ql) - 1)), k, axis=1)[:, :k + 1]
            at = np.repeat(np.arange(len(other)), likely.shape[1])
            sure = _pair_products(q[own][at], c[likely.ravel()]).astype(np.float64).reshape(likely.shape)
            sure = np.where(np.take_along_axis(other, likely, axis=1), sure, -np.inf)
            floor = np.maximum(floor, np.sort(sure, axis=1)[:, -k])
        left = other
        for level in range(len(ql)):
            before = np.count_nonzero(left)
            left = left & (bound(level) >= floor[:, None])
            if level >= 2 and np.count_nonzero(left) > 0.9 * before:
                break
        # Columns that any of these queries keeps are multiplied together; of the products only survivors' count.
        some = np.flatnonzero(left.any(axis=0))
        scores = exact_products(q[own], c[some])
        at, to = np.nonzero(left[:, some] & (scores.astype(np.float64) >= floor[:, None]))  # rounding keeps order
        _push(heaps, k, s + at, ci[some[to]], scores[at, to])


def nearest_by_tiles(rows: DataFrame, query: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for every row where ``query`` (over ``vec_id``) holds, exactly.

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller id.  Rows without id, and vectors null, zero or
    holding null or non-finite components take no part; a fully repeated row counts once; vectors meet only those of
    their own length; a query never meets its own id.  Fewer candidates give fewer rows, an empty table none.
    """
    told = usable(rows, vec, True).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    return _search(told, query, k, int8_tile, "double")


def top_by_segments(rows: DataFrame, query: Column, k: int = 5, factor: int = 256, vec_id: str = "vec_id",
                    vec: str = "embedding") -> DataFrame:
    """The k rows of largest integer inner product of ``floor(factor * x)``, exactly.

    Same columns and rules as ``nearest_by_tiles``, but zero vectors take part.  Components and scores beyond a long end
    at its limits; products are exact whatever their size.
    """
    told = usable(rows, vec, False).select(F.col(vec_id).cast("long").alias("vec_id"),
                                           F.transform(vec, lambda x: F.floor(x.cast("double") * factor)).alias("v"))
    return _search(told, query, k, segment_tile, "long")
