"""Hard negatives by shared candidate lists: each cluster of anchors sorts the candidates once, by an angular upper bound.

Anchors are grouped by direction.  For a cluster with centre m whose members lie within angle b of it, a candidate c at
angle g from m has no larger product with a member a than |a| |c| cos(max(0, g - b)).  The candidates of a block are sorted
by that bound without |a|, once per cluster; every member walks the one list and stops where the bound proves that
nothing behind can enter its results.  All products are exact integers, so the results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, keep
from .integers import clamped, exact_products, fits_double

ANCHOR_BLOCK, CANDIDATE_BLOCK, STEP = 4096, 8192, 512
ANGLE_SLACK = 1e-6


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and lengths; a zero row stays zero."""
    # Divided first, so components near the end of the range cannot overflow when squared.
    top = np.abs(v).max(axis=1, initial=0.0)
    top[top == 0] = 1
    scaled = v / top[:, None]
    length = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / np.where(length > 0, length, 1)[:, None], length * top


def spherical_centres(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``k`` clusters of the rows' directions; the start is spread, so reruns agree."""
    unit = np.unique(directions(v)[0], axis=0)
    if not len(unit):
        return unit
    centres = [unit[0]]
    near = unit @ unit[0]
    while len(centres) < min(k, len(unit)):  # the row farthest from all centres so far
        centres.append(unit[int(np.argmin(near))])
        near = np.maximum(near, unit @ centres[-1])
    centre = np.stack(centres)
    for _ in range(rounds):
        of = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, unit)
        moved, length = directions(total)
        centre = np.where(length[:, None] > 0, moved, centre)
    return centre


class _Best:
    """The first ``k`` (score, id) of one walk among scores up to ``cap``: higher scores, then smaller ids."""

    __slots__ = ("k", "low", "cap", "scores", "ids")

    def __init__(self, k: int, low: int | None = None, cap: int | None = None):
        self.k, self.low, self.cap = k, low, cap
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> float:
        """Products below this cannot enter."""
        full = self.scores[-1] if len(self.scores) == self.k else None
        known = [x for x in (full, self.low) if x is not None]
        return max(known) if known else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.ones(len(scores), bool)
        if self.cap is not None:
            fits &= scores <= self.cap
        least = self.floor()
        if least > -np.inf:
            fits &= scores >= least
        if not fits.any():
            return
        told = scores[fits]
        s = np.concatenate([self.scores, told if told.dtype == object else told.astype(np.int64)])
        i = np.concatenate([self.ids, ids[fits]])
        if s.dtype == object:
            order = sorted(range(len(s)), key=lambda at: (-s[at], i[at]))[:self.k]
        else:
            order = np.lexsort((i, -s))[:self.k]
        self.scores, self.ids = s[order], i[order]


def walk(members: np.ndarray, member_ids: np.ndarray, wanted: Sequence[Sequence[_Best]], candidates: np.ndarray,
         candidate_ids: np.ndarray, admits: Callable[[int, np.ndarray], np.ndarray]) -> int:
    """Walks one cluster's members down the shared list of candidates and fills ``wanted``; returns the products made.

    ``admits(member, places)`` tells which candidates a member may take.
    """
    unit, length = directions(members.astype(np.float64))
    c_unit, c_length = directions(candidates.astype(np.float64))
    centre, whole = directions(unit.sum(axis=0)[None, :])
    if whole[0] > 0:
        wide = float(np.arccos(np.clip(unit @ centre[0], -1, 1)).max(where=length > 0, initial=0.0)) + ANGLE_SLACK
    else:
        wide = np.pi
    away = np.arccos(np.clip(c_unit @ centre[0], -1, 1))
    bound = c_length * np.cos(np.maximum(0, away - wide))
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    # What rounding of lengths, cosines and bounds may hide.
    slack = 1e-9 * float(c_length.max(initial=0.0))
    c, ids = candidates[order], candidate_ids[order]
    narrow = fits_double(members, candidates)
    if narrow:
        c, members = c.astype(np.float64), members.astype(np.float64)
    active, made = np.arange(len(members)), 0
    for start in range(0, len(c), STEP):
        top = bound[start] + slack
        active = np.array([a for a in active if any(w.floor() <= length[a] * top + 1e-6 for w in wanted[a])], np.int64)
        if not len(active):
            break
        part, part_ids = c[start:start + STEP], ids[start:start + STEP]
        scores = members[active] @ part.T if narrow else exact_products(members[active], part)
        made += scores.size
        for row, a in enumerate(active):
            fits = (part_ids != member_ids[a]) & admits(a, order[start:start + STEP])
            for w in wanted[a]:
                w.add(scores[row][fits], part_ids[fits])
    return made


def _vectors(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1) if len(table) else np.empty((0, 0), np.int64)


def _with_cluster(anchors: DataFrame, clusters: int, sample: int) -> DataFrame:
    """Adds ``cluster`` by the nearest of the centres fitted, per length of vector, on ``sample`` anchors at most."""
    some = anchors.select("dim", "v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample)

    def fit(table: pa.Table) -> pa.Table:
        centre = spherical_centres(_vectors(table, "v").astype(np.float64), clusters)
        return pa.table({"dim": pa.array([len(centre[0]) if len(centre) else 0], pa.int32()),
                         "centres": pa.array([centre.tobytes()], pa.binary())})

    # Bounded by the sample: at most ``clusters`` centres for each length that occurs in it.
    centres = some.groupBy("dim").applyInArrow(fit, "dim int, centres binary")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.zeros(len(batch), np.int32)
            raw = batch.column("centres")
            for at in range(len(batch)):
                x = np.asarray(batch.column("v")[at].values.to_numpy(zero_copy_only=False), np.float64)
                if raw[at].is_valid and len(x):
                    of[at] = int(np.argmax(np.frombuffer(raw[at].as_buffer()).reshape(-1, len(x)) @ x))
            rest = [n for n in batch.schema.names if n != "centres"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(of)], [*rest, "cluster"])

    joined = anchors.join(F.broadcast(centres), "dim", "left").select(*anchors.columns, "centres")
    return joined.mapInArrow(place, T.StructType([*anchors.schema.fields, T.StructField("cluster", T.IntegerType())]))


def _rows(found: list[tuple], names: str) -> pa.Table:
    columns = list(zip(*found)) if found else [[] for _ in names.split()]
    return pa.table({n: pa.array(c, pa.int32() if n == "place" else pa.int64()) for n, c in zip(names.split(), columns)})


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100),
         high: tuple[int, int] = (90, 100), factor: int = 256, clusters: int = 64, sample: int = 4096,
         vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its positives the nearest rows of other labels that are not too near.

    Components are floored after scaling by ``factor``; a row's score is its integer product with the anchor.  Positives are
    the first ``positives`` other rows of the anchor's label; negatives the first ``negatives`` rows of other labels with
    ``low * positive <= score <= high * positive`` (fractions).  Higher scores come first, ties by smaller id.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.  Rows with a null id, label or
    vector, or a null or non-finite component take no part; a fully repeated row counts once, and an id with two vectors
    is two rows, none of which is "another row" for its own id.  Vectors meet those of their own length only.  Zero
    vectors score 0.  Components and scores beyond a long end at its limits.  Anchors without positives, positives
    without negatives and empty tables give no rows; other columns are ignored.

    The centres are fitted on ``sample`` anchors; they decide only how early walks end, not what is found.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    x = F.col(vec)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    told = (rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * factor)).alias("v"))
            .distinct().withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("vec_id", "label", "v")))
    told = keep(told, "mined-rows")
    own = keep(_with_cluster(told.filter(anchor), clusters, sample), "anchors")
    # A cluster owns a stretch of blocks as long as its share of the anchors; its members are dealt over it.
    counts = own.groupBy("dim", "cluster").count()
    before = Window.partitionBy("dim").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    stretch = counts.select("dim", "cluster", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"), "count")
    place = F.col("first") + F.pmod("h", "count")
    own = keep(own.join(F.broadcast(stretch), ["dim", "cluster"])
               .select("dim", F.floor(place / ANCHOR_BLOCK).cast("int").alias("qb"), "cluster", "vec_id", "label", "v", "h"), "anchors")
    blocks = own.groupBy("dim").agg((F.max("qb") + 1).alias("nq"))
    nc = max(1, -(-told.count() // CANDIDATE_BLOCK))
    cb = F.pmod("h", F.lit(nc)).cast("int").alias("cb")
    none = F.lit(None).cast("array<long>")

    def meet(asking: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
        """Every block of anchors with every block of candidates; the candidates' side is repeated per block of anchors."""
        asking = (asking.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
                  .select("dim", "qb", "cb", F.lit(True).alias("asks"), "vec_id", "v", "h", "label", "cluster", "positive"))
        # At most one row per length of vector that anchors have; joined by the planner's own size-checked choice.
        answering = (told.join(blocks, "dim").withColumn("qb", F.explode(F.expr("sequence(0, nq - 1)")))
                     .select("dim", "qb", cb, F.lit(False).alias("asks"), "vec_id", "v", "h", "label", F.lit(0).alias("cluster"),
                             none.alias("positive")))
        return asking.unionByName(answering).groupBy(*keys, "qb", "cb").applyInArrow(run, schema)

    def sides(table: pa.Table):
        asks = table.filter(table.column("asks"))
        return asks, table.filter(pc.invert(table.column("asks")))

    def by_cluster(asks: pa.Table) -> Iterator[np.ndarray]:
        of = asks.column("cluster").to_numpy()
        for c in np.unique(of):
            yield np.flatnonzero(of == c)

    def near(table: pa.Table) -> pa.Table:
        asks, others = sides(table)
        found = []
        if len(asks) and len(others):
            a, c = _vectors(asks, "v"), _vectors(others, "v")
            a_ids, c_ids, h = asks.column("vec_id").to_numpy(), others.column("vec_id").to_numpy(), asks.column("h").to_numpy()
            for at in by_cluster(asks):
                best = [[_Best(positives)] for _ in at]
                walk(a[at], a_ids[at], best, c, c_ids, lambda member, places: np.ones(len(places), bool))
                found += [(int(a_ids[i]), int(h[i]), int(j), clamped(s)) for i, (b,) in zip(at, best) for s, j in zip(b.scores, b.ids)]
        return _rows(found, "anchor_id h positive_id positive_score")

    by_label = meet(own.withColumn("positive", none), ["dim", "label"], near,
                    "anchor_id long, h long, positive_id long, positive_score long").distinct()
    first = Window.partitionBy("anchor_id", "h").orderBy(F.col("positive_score").desc(), "positive_id")
    near_rows = keep(by_label.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives), "positives")
    # A list of at most ``positives`` scores travels with each anchor.
    scores = near_rows.groupBy("anchor_id", "h").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))),
                                                                 lambda p: p["positive_score"]).alias("positive"))
    asking = own.join(scores.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "h"])

    def hard(table: pa.Table) -> pa.Table:
        asks, others = sides(table)
        found = []
        if len(asks) and len(others):
            a, c = _vectors(asks, "v"), _vectors(others, "v")
            a_ids, c_ids, h = asks.column("vec_id").to_numpy(), others.column("vec_id").to_numpy(), asks.column("h").to_numpy()
            labels = pa.chunked_array([*asks.column("label").chunks, *others.column("label").chunks]).combine_chunks().dictionary_encode()
            of = labels.indices.to_numpy()
            a_of, c_of = of[:len(asks)], of[len(asks):]
            told_scores = asks.column("positive").to_pylist()
            for at in by_cluster(asks):
                # The limits in whole numbers: ceil(low * p) and floor(high * p).
                best = [[_Best(negatives, -(-low[0] * p // low[1]), high[0] * p // high[1]) for p in told_scores[i]] for i in at]
                kinds = a_of[at]
                walk(a[at], a_ids[at], best, c, c_ids, lambda member, places: c_of[places] != kinds[member])
                found += [(int(a_ids[i]), int(h[i]), place, int(j), clamped(s)) for i, walks in zip(at, best)
                          for place, b in enumerate(walks, 1) for s, j in zip(b.scores, b.ids)]
        return _rows(found, "anchor_id h place negative_id negative_score")

    met = meet(asking, ["dim"], hard, "anchor_id long, h long, place int, negative_id long, negative_score long").distinct()
    next_ = Window.partitionBy("anchor_id", "h", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(next_)).filter(F.col("rank") <= negatives)
    return (ranked.join(near_rows, ["anchor_id", "h", "place"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
