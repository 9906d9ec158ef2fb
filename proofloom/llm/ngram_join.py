"""N-gram Jaccard join of documents by R-trees over count vectors.

A document is its set of distinct word shingles.  Shingles are hashed into groups; the counts by group are a point, and
the sum of coordinate minima of two points bounds the overlap of their sets, also between a point and the box of a tree
node.  Pairs that survive the bound are verified on the sets.

What may be compared at all is found by cells.  Linked sets of known sizes differ in at most d shingles.  Shingles are
hashed into more than d cells; each one that differs spoils one cell, so all cells but d hold the same in both sets, and
in any one order of cells by what they hold, linked sets have one in common among the first d + 1 of each.  The order
is by how rare a cell's shingles are, so what many documents have in common comes last; and a cell holds several
shingles, so sets that share some by chance, or a passage, do not agree in one.  Documents that agree in a cell are
brought together by the first of them, without pairs, and in windows of size, since linked sets differ little in it: a set
stands in two windows, and a chain of chance acquaintances ends at their borders.  Each connected bunch is then one R-tree's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, keep, lower_words, pieces
from .graph import components

# Shingles of one tree; a bunch that holds more is dealt over several.
CHUNK = 1 << 19
# Where every part meets every other, parts are so much larger, as all of them are repeated to each.
WIDE = 4
DIMS, LEAF = 32, 32
COUNTERS, SLICES = 1 << 20, 16
# Bits by which rows are told apart before a join on ids; 2 MB whatever the number of ids.
MARKS = 1 << 24
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input changes about half of the bits."""
    x = (x ^ (x >> np.uint64(32))) * B
    x = (x ^ (x >> np.uint64(29))) * A
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a whole text; fewer words: the sequence as one."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
             for w in map(lower_words, pieces(text or "")) if w]
    if not parts:
        return np.empty(0, np.uint64)
    h = np.concatenate(parts)
    size = min(k, len(h))
    n, all_ = len(h) - size + 1, np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        all_ = mixed(all_ * A + h[i:i + n])
    return np.unique(all_)


def node_of(s: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    return int(mixed(mixed(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


class Threshold:
    """Jaccard similarity of num/den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, inter, both):
        """Whether an overlap suffices, given the sum of the sizes."""
        return inter * (self.num + self.den) >= self.num * both

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Classes grow by 1/t, so those of linked sets differ by one at most.  A set stands in the windows of its class and the one below."""
        return np.floor(np.log(np.maximum(n, 1)) / self._step()).astype(np.int64)

    def apart(self, window: np.ndarray) -> np.ndarray:
        """In how many shingles linked sets of a window differ at most, where the smaller is of the window's own class."""
        small = np.floor(np.exp((window + 1) * self._step()) * (1 + 1e-9)).astype(np.int64)
        return (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def _step(self) -> float:
        return max(math.log(self.den / self.num), 1e-6) * (1 + 1e-9)

    def keys(self, sets: list[np.ndarray], window: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all sets, one after the other, and how many each has.

        A key is a cell with what it holds; of every two linked sets of a window one key is equal.
        """
        sizes = np.array([len(s) for s in sets], np.int64)
        wanted = np.where(sizes > 0, self.apart(window) + 1, 0)
        cells = wanted + wanted // 2
        first, total = np.cumsum(cells) - cells, int(cells.sum())
        flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
        hashed = mixed(flat)
        at = np.repeat(first, sizes) + (hashed % np.repeat(np.maximum(cells, 1), sizes).astype(np.uint64)).astype(np.int64)
        # Powers of two, so sums are exact in any order.
        rare = np.exp2(np.minimum(int(heights.max(initial=0)) - heights[flat & np.uint64(len(heights) - 1)].astype(np.int64), 32))
        weight, held = np.bincount(at, weights=rare, minlength=total), np.zeros(total, np.uint64)
        np.add.at(held, at, mixed(hashed + A))
        owner = np.repeat(np.arange(len(sets)), cells)
        place = (np.arange(total) - first[owner]).astype(np.uint64)
        key = mixed(held + mixed(place * A + window[owner].astype(np.uint64) * B))
        order = np.lexsort((key, -weight, owner))
        return key[order[place < wanted[owner].astype(np.uint64)]], wanted


class CountTree:
    """R-tree over count vectors, packed: points sorted into leaves by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._pack(points, np.arange(len(points)))
        self.boxes, self.least, self.most, top, low, high = [], [], [], points[self.order], sizes[self.order], sizes[self.order]
        while len(top) > 1 or not self.boxes:
            starts = np.arange(0, len(top), LEAF)
            top, low, high = (np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts))
            self.boxes.append(top)
            self.least.append(low)
            self.most.append(high)

    def _pack(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        done, todo = [], [at]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                done.append(at)
                continue
            own = points[at]
            half = -(-len(at) // LEAF) // 2 * LEAF
            order = np.argpartition(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], half)
            todo += [at[order[half:]], at[order[:half]]]
        return np.concatenate(done)

    def near(self, point: np.ndarray, size: int, limit: Threshold, skip) -> np.ndarray:
        """Places, in packed order, of leaves' points that boxes cannot rule out.  ``skip(height, nodes)`` tells
        which nodes need no visit."""
        nodes = np.zeros(1, np.int64)
        for height in range(len(self.boxes) - 1, -1, -1):
            nodes = nodes[~skip(height, nodes)]
            bound = np.minimum(np.minimum(self.boxes[height][nodes], point).sum(axis=1), np.minimum(self.most[height][nodes], size))
            nodes = nodes[limit.linked(bound, size + self.least[height][nodes])]
            below = len(self.order) if height == 0 else len(self.boxes[height - 1])
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        return nodes


def link(sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray | None, limit: Threshold) -> list[tuple[int, int]]:
    """Verified links (i, j) that join all linked sets, without those inside what is joined already.

    ``labels``: known classes; ``asks``: sets whose partners are wanted (None: all).
    """
    sizes = np.array([len(s) for s in sets])
    points = np.stack([np.bincount((s >> np.uint64(40)) % np.uint64(DIMS), minlength=DIMS) for s in sets])
    tree = CountTree(points, sizes)
    order, points, sizes = tree.order, points[tree.order], sizes[tree.order]
    labels = np.unique(labels, return_inverse=True)[1][order]
    members = {c: np.flatnonzero(labels == c) for c in range(labels.max() + 1)} if len(labels) < 4096 else None
    found, same = [], []

    def uniform() -> list[np.ndarray]:
        """Per height, which nodes hold one class only.  A node stays so."""
        low = high = labels
        out = []
        for _ in tree.boxes:
            starts = np.arange(0, len(low), LEAF)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(low == high)
        return out

    for turn, i in enumerate(range(len(order)) if asks is None else np.flatnonzero(asks[order]).tolist()):
        if turn % 64 == 0:
            same = uniform()

        def skip(height, nodes):
            width = LEAF ** (height + 1)
            mine = same[height][nodes] & (labels[nodes * width] == labels[i])
            return mine | ((nodes + 1) * width <= i + 1) if asks is None else mine

        to = tree.near(points[i], sizes[i], limit, skip)
        to = to[(to > i if asks is None else to != i) & (labels[to] != labels[i])]
        to = to[limit.linked(np.minimum(points[to], points[i]).sum(axis=1), sizes[to] + sizes[i])]
        for j in to.tolist():
            if labels[j] != labels[i]:
                own, other = sets[order[i]], sets[order[j]]
                inter = len(np.intersect1d(own, other, assume_unique=True))
                if limit.linked(inter, len(own) + len(other)):
                    found.append((int(order[i]), int(order[j])))
                    a, b = int(labels[i]), int(labels[j])
                    if members is None:
                        labels[labels == b] = a
                    else:
                        if len(members[a]) < len(members[b]):
                            a, b = b, a
                        labels[members[b]] = a
                        members[a] = np.concatenate([members[a], members.pop(b)])
    return found


def every_link(sets: list[np.ndarray], upper: np.ndarray, asks: np.ndarray | None, limit: Threshold) -> Iterator[tuple[int, np.ndarray]]:
    """All verified links: a set and its partners, each pair once.

    ``upper``: sets of the window's larger class; pairs of two of them belong to the next window.
    ``asks``: sets that meet those that do not ask (None: all meet all).
    """
    sizes = np.array([len(s) for s in sets])
    points = np.stack([np.bincount((s >> np.uint64(40)) % np.uint64(DIMS), minlength=DIMS) for s in sets])
    tree = CountTree(points, sizes)
    order, points, sizes, upper = tree.order, points[tree.order], sizes[tree.order], upper[tree.order]
    asks = None if asks is None else asks[order]
    # Shingles as places of a table in which one set's are marked, so overlaps are sums over it.
    places = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    ends, marked = np.cumsum(sizes), np.zeros(len(places), np.uint8)
    for i in range(len(order)) if asks is None else np.flatnonzero(asks).tolist():

        def skip(height, nodes):
            return (nodes + 1) * LEAF ** (height + 1) <= i + 1 if asks is None else np.zeros(len(nodes), bool)

        to = tree.near(points[i], sizes[i], limit, skip)
        to = to[(to > i if asks is None else ~asks[to]) & ~(upper[to] & upper[i])]
        to = to[limit.linked(np.minimum(points[to], points[i]).sum(axis=1), sizes[to] + sizes[i])]
        if not len(to):
            continue
        own, n = places[ends[i] - sizes[i]:ends[i]], sizes[to]
        first = np.cumsum(n) - n
        marked[own] = 1
        inter = np.add.reduceat(marked[places[np.repeat(ends[to] - n - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
        marked[own] = 0
        to = to[limit.linked(inter, n + sizes[i])]
        if len(to):
            yield int(order[i]), order[to]


def _heights(docs: DataFrame, k: int, text: str) -> np.ndarray:
    """Per counter, the binary length of how often its shingles occur over all documents.

    ``COUNTERS`` counters whatever the size of the input; they are summed in slices, and one byte each reaches the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            found = [shingle_set(t.as_py(), k) & np.uint64(COUNTERS - 1) for t in batch.column(0)]
            met += np.bincount(np.concatenate(found).astype(np.int64), minlength=COUNTERS)
        parts = np.split(met.astype("<i4"), SLICES)
        yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "met": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), "<i4").astype(np.int64) for b in table.column("met"))
        return pa.table({"slice": table.column("slice")[:1], "height": pa.array([np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})

    summed = docs.select(F.col(text).alias("text")).mapInArrow(count, "slice int, met binary").groupBy("slice").applyInArrow(
        add, "slice int, height binary")
    rows = sorted((r.slice, r.height) for r in summed.toLocalIterator())
    return np.frombuffer(b"".join(h for _, h in rows), np.uint8) if rows else np.zeros(COUNTERS, np.uint8)


def _features(docs: DataFrame, k: int, limit: Threshold, doc_id: str, text: str) -> DataFrame:
    """``doc_id, told, n, node, class, keys, upper_keys``: text hash, set size, set hash, size class and keys of every
    document in the window of its class, and in the one below, where it is one of the larger.

    Of rows with equal sets the first with an id in each task states the keys, the others none."""
    sent = docs.sparkSession.sparkContext.broadcast(_heights(docs, k, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heights, seen = sent.value, set()
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column(1)]
            sizes, nodes, stating = np.array(list(map(len, sets)), np.int64), list(map(node_of, sets)), []
            for s, node, known in zip(sets, nodes, batch.column(0).is_valid().to_pylist()):
                stating.append(s if known and node not in seen else s[:0])
                seen.add(node) if known else None
            own, keys = limit.size_class(sizes), []
            for window in (own, own - 1):
                found, many = limit.keys(stating, window, heights)
                keys.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(found.view(np.int64), pa.int64())))
            yield pa.record_batch({
                "doc_id": batch.column(0), "told": batch.column(2), "n": pa.array(sizes), "node": pa.array(nodes, pa.int64()),
                "class": pa.array(own), "keys": keys[0], "upper_keys": keys[1]})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("told")).mapInArrow(
        run, "doc_id long, told long, n long, node long, class long, keys array<long>, upper_keys array<long>")


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` has a mark of ``ids``: all that a join on it needs, and a few more."""
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    bucket, place = F.bitmap_bucket_number(mark).alias("bucket"), F.bitmap_bit_position(mark).alias("place")
    marks = ids.select(bucket, place).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    met = "getbit(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) = 1"
    return docs.select("*", bucket, place).join(F.broadcast(marks), "bucket").filter(met).select(*docs.columns)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """``node, spots, content`` of ``node, spots, text``; of rows of one id, those of that node, and these once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets, wanted = [shingle_set(t.as_py(), k) for t in batch.column("text")], []
            for s, node in zip(sets, batch.column("node").to_pylist()):
                wanted.append(node not in seen and node_of(s) == node)
                seen.add(node) if wanted[-1] else None
            yield pa.record_batch({"node": batch.column("node"), "spots": batch.column("spots"),
                                   "content": pa.array([s.tobytes() for s in sets], pa.binary())}).filter(pa.array(wanted, pa.bool_()))

    texts = texts.select("node", "spots", "text")
    return texts.mapInArrow(run, texts.drop("text").withColumn("content", F.lit(None).cast("binary")).schema)


def _linked(units: DataFrame, limit: Threshold) -> DataFrame:
    """``a, b``: links found in each (unit, part, other) of ``node, root, content, label, asks``."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("root")
        roots, nodes = table.column("root").to_numpy(), table.column("node").to_numpy()
        labels, asks = table.column("label").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        content, found = table.column("content"), []
        starts = [*np.flatnonzero(np.r_[True, roots[1:] != roots[:-1]]).tolist(), len(roots)]
        for a, b in zip(starts, starts[1:]):
            sets = [np.frombuffer(content[i].as_buffer(), np.uint64) for i in range(a, b)]
            wanted = None if asks[a:b].all() else asks[a:b]
            found += [(nodes[a + i], nodes[a + j]) for i, j in link(sets, labels[a:b], wanted, limit)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return units.groupBy("unit", "part", "other").applyInArrow(run, "a long, b long")


def _all_linked(units: DataFrame, limit: Threshold, pairs: bool) -> DataFrame:
    """``a, b, n`` of all links in each (unit, part, other) of ``node, root, content, asks, upper, copies``.

    ``pairs``: every link as a row, n = 0.  Else links that join all linked sets, n = 0, and a row (node, node, n) per
    linked set with the copies of its partners here, so rows do not grow with the square of a group.
    """
    def run(table: pa.Table) -> pa.Table:
        # Contents of repeated rows can come more than once.
        table = table.sort_by([("root", "ascending"), ("node", "ascending")])
        roots, nodes = table.column("root").to_numpy(), table.column("node").to_numpy()
        table = table.filter(pa.array(np.r_[True, (roots[1:] != roots[:-1]) | (nodes[1:] != nodes[:-1])]))
        roots, nodes, copies = (table.column(c).to_numpy() for c in ("root", "node", "copies"))
        upper, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("upper", "asks"))
        content, found = table.column("content"), [np.empty((3, 0), np.int64)]
        starts = [*np.flatnonzero(np.r_[True, roots[1:] != roots[:-1]]).tolist(), len(roots)]
        for a, b in zip(starts, starts[1:]):
            sets = [np.frombuffer(content[i].as_buffer(), np.uint64) for i in range(a, b)]
            own, weight, labels, total = nodes[a:b], copies[a:b], np.arange(b - a), np.zeros(b - a, np.int64)
            for i, to in every_link(sets, upper[a:b], None if asks[a:b].all() else asks[a:b], limit):
                total[i] += weight[to].sum()
                total[to] += weight[i]
                if not pairs:
                    classes, at = np.unique(labels[to], return_index=True)
                    to = to[at[classes != labels[i]]]
                    if len(to):
                        labels[np.isin(labels, classes)] = labels[i]
                found.append(np.stack([np.full(len(to), own[i]), own[to], np.zeros(len(to), np.int64)]))
            if not pairs:
                linked = np.flatnonzero(total)
                found.append(np.stack([own[linked], own[linked], total[linked]]))
        a, b, n = np.concatenate(found, axis=1)
        return pa.table({"a": a, "b": b, "n": n})

    return units.groupBy("unit", "part", "other").applyInArrow(run, "a long, b long, n long")


def _links(docs: DataFrame, told: DataFrame, bunches: DataFrame, k: int, limit: Threshold, every: str | None = None) -> DataFrame:
    """Links between sets of the same root, for ``docs(doc_id, text)``, ``told(node, keys, upper_keys)`` and
    ``bunches(doc_id, node, n, root, upper, copies)``.

    ``every`` None: ``a, b``, enough of them to join all linked sets.  "counts" or "pairs": ``a, b, n`` of all links as in
    ``_all_linked``; then every set of a large bunch meets the other parts, and the later part asks.

    Small bunches share units; a large one is dealt over parts by hash, linked inside each, and then only sets outside
    its largest class so far still meet the other parts: those of them that state one of its keys.  All places are settled on ids and sizes; a set's content is
    written once, and repeated only in the exchange that brings it to its places.
    """
    chunk = CHUNK * WIDE if every else CHUNK
    volume = keep(bunches.groupBy("root").agg(F.sum("n").alias("v")), "volumes")
    total = volume.agg(F.sum("v")).first()[0] or 0
    bins = max(1, -(-total // (CHUNK // 2)))
    many = F.col("parts") > 1
    placed = keep(bunches.join(volume.select("root", F.ceil(F.col("v") / chunk).alias("parts")), "root").select(
        "doc_id", "node", "n", "root", "upper", "copies", "parts",
        F.when(many, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("unit"),
        F.when(many, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(-1)).cast("long").alias("part")), "places")
    spots = placed.groupBy("doc_id", "node").agg(F.collect_list(F.struct("unit", "part", "root", "upper", "copies")).alias("spots"))
    contents = keep(_sets(_marked(docs, placed).join(spots, "doc_id"), k), "contents")
    first = contents.select("node", "content", F.explode("spots").alias("s")).select(
        "s.unit", "s.part", F.lit(-1).alias("other"), "node", "s.root", "content", F.col("node").alias("label"), F.lit(True).alias("asks"),
        "s.upper", "s.copies")
    find = (lambda units: _all_linked(units, limit, every == "pairs")) if every else (lambda units: _linked(units, limit))
    inside = keep(find(first), "links")
    if not volume.filter(F.col("v") > chunk).limit(1).count():
        return inside
    classed = placed.filter("part >= 0").select("doc_id", "root", "node", "n", "part", "upper", "copies")
    if every:
        dealt = keep(classed.withColumn("label", F.col("node")).withColumn("outside", F.lit(True)), "dealt")
    else:
        roots = components(inside).withColumnRenamed("root", "label")
        classed = keep(classed.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "classed")
        counted = classed.groupBy("root", "label").agg(F.count("*").alias("c"))
        main = counted.groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"))
        dealt = keep(classed.join(main.filter("labels > 1").drop("labels"), "root").withColumn("outside", F.col("label") != F.col("main")).drop("main"), "dealt")
    # An outsider asks the other parts that state one of its keys; of two outsiders the one in the later part asks.
    keyed = keep(told.filter("size(keys) > 0").select("node", "keys", "upper_keys").join(dealt.select("node", "root", "part", "outside", "upper"), "node")
                 .select("root", "node", "part", "outside", F.explode(F.when(F.col("upper"), F.col("upper_keys")).otherwise(F.col("keys"))).alias("key"))
                 .distinct(), "large-keys")
    stated = keyed.select("root", "key", F.col("part").alias("to"), F.col("outside").alias("other_outside")).distinct()
    pairs = keep(keyed.filter("outside").join(stated, ["root", "key"]).filter("`to` < part or (`to` > part and not other_outside)")
                 .select("root", "key", "node", "to"), "asked")
    asking = pairs.select("root", "node", "to").distinct()
    hosting = (keyed.withColumnRenamed("part", "to").join(pairs.select("root", "key", "to").distinct(), ["root", "key", "to"], "left_semi")
               .select("root", "node", "to").distinct())
    sizes = dealt.select("root", "node", "n", "label", "upper", "copies")
    asking = keep(asking.join(sizes, ["root", "node"]), "asking")
    # Those who ask one part come in groups of a chunk; the part is repeated for each group.
    groups = keep(asking.groupBy("root", "to").agg(F.ceil(F.sum("n") / chunk).cast("long").alias("groups")), "groups")
    spot = lambda other, asks: F.struct("root", "to", other.cast("long").alias("other"), "label", F.lit(asks).alias("asks"), "upper", "copies")
    askers = asking.join(groups, ["root", "to"]).select("node", spot(F.pmod(F.xxhash64("node", "root"), F.col("groups")), True).alias("s"))
    hosts = hosting.join(sizes, ["root", "node"]).join(groups, ["root", "to"]).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("node", spot(F.col("other"), False).alias("s"))
    plan = keep(askers.unionByName(hosts).groupBy("node").agg(F.collect_list("s").alias("spots")), "plan")
    large = contents.filter(F.exists("spots", lambda s: s["part"] >= 0)).select("node", "content").join(plan, "node")
    met = large.select("node", "content", F.explode("spots").alias("s")).select(
        F.col("s.root").alias("unit"), F.col("s.to").alias("part"), "s.other", "node", "s.root", "content", "s.label", "s.asks", "s.upper", "s.copies")
    return inside.unionByName(keep(find(met), "links"))


def _bunched(docs: DataFrame, k: int, limit: Threshold, doc_id: str, text: str, counted: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Features of all rows, those that take part, one row per set with its copies, and the bunches of sets that may be linked.

    ``copies`` are documents of that set, repeated rows counted once; 1 unless ``counted``.
    """
    bounded_batches(docs.sparkSession)
    feats = keep(_features(docs, k, limit, doc_id, text), "features")
    told = feats.filter("n > 0 and doc_id is not null")
    # The first of the two windows of a set is that of the class below its own: there it is one of the upper sets.  Two
    # upper sets also meet in the next window, so a key of upper sets only brings nobody together.
    stand = F.explode(F.array(*[F.struct(F.lit(pos).alias("pos"), (F.col("class") - 1 + pos).alias("window"), F.col(c).alias("keys"))
                                for pos, c in enumerate(("upper_keys", "keys"))])).alias("s")
    keyed = told.filter("size(keys) > 0").select("node", stand).select(
        F.xxhash64("node", "s.window").alias("place"), "s.pos", F.explode("s.keys").alias("key"))
    # Rows of a key pass in order, its own class first, so keys are exchanged once and none is held as a whole.
    so_far = Window.partitionBy("key").orderBy(F.desc("pos"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = keyed.select("place", F.first("place").over(so_far).alias("lead"), F.first("pos").over(so_far).alias("own"))
    near = keep(led.filter("own = 1 and place <> lead").select(F.col("place").alias("a"), F.col("lead").alias("b")).distinct(), "near")
    once = told.select("node", "doc_id", "n", "class").distinct() if counted else told
    classes = keep(once.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("class").alias("class"),
                                            (F.count("*") if counted else F.lit(1).cast("long")).alias("copies")), "classes")
    places = classes.select("node", "doc_id", "n", "copies", F.posexplode(F.array(F.col("class") - 1, F.col("class"))).alias("pos", "window"))
    bunches = keep(places.join(components(near).withColumnRenamed("node", "place"), F.xxhash64(places["node"], "window") == F.col("place"))
                   .select("doc_id", "node", "n", "root", (F.col("pos") == 0).alias("upper"), "copies"), "bunches")
    return feats, told, classes, bunches


def _grouped(docs: DataFrame, k: int, limit: Threshold, doc_id: str, text: str, counted: bool) -> DataFrame:
    """``doc_id, told, node, root, n_shingles, component_id`` per row, and ``n_links`` if ``counted``.  No node: takes no part.

    ``told`` is the hash of the text, ``root`` the node that stands for the component: one id can be the least of two.
    """
    feats, told, classes, bunches = _bunched(docs, k, limit, doc_id, text, counted)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    links = _links(texts, told, bunches, k, limit, "counts" if counted else None)
    linked = components(links.select("a", "b"))
    rooted = classes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if counted:
        met = links.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("met"))
        rooted = rooted.join(met, "node", "left").withColumn("n_links", F.coalesce("met", F.lit(0)) + F.col("copies") - 1)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = ["n_links"] if counted else []
    named = keep(rooted.join(least, "root").select("node", "root", "component_id", *own), "named")
    out = feats.select("doc_id", "told", F.col("n").alias("n_shingles"), F.when(F.expr("n > 0 and doc_id is not null"), F.col("node")).alias("node"))
    return out.join(named, "node", "left").select("doc_id", "told", "node", "root", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                                                  *[F.coalesce(c, F.lit(0)).alias(c) for c in own])


def similar_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document: linked are sets with Jaccard similarity num/den or more.

    ``component_id`` is the smallest id reachable over links.  Equal sets are one node, however many copies there are; a
    node is a 64-bit hash of the set.  Null, empty and blank texts have no shingles and are linked with
    nothing; rows with a null id keep their size, take no part and have a null component; rows of equal id and text give
    equal rows, and of one id with several texts each row is judged by its own text.  Other columns are ignored.
    Only links that join what is not joined yet are verified; ``linked_groups`` has the number of all links.
    """
    return _grouped(docs, k, Threshold(num, den), doc_id, text, False).drop("told", "node", "root")


def linked_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``similar_groups`` and ``n_links``: with how many other documents a document is linked directly.

    All links are verified.  A document is an id with a set: repeated rows of both count once, other ids with the same set
    are links, and so are linked texts of one id.  Rows that take no part have 0.
    """
    return _grouped(docs, k, Threshold(num, den), doc_id, text, True).drop("told", "node", "root")


def linked_sets(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links as ``a, b`` (a < b), each pair of distinct sets once, and ``doc_id, node``: the documents of each set."""
    limit = Threshold(num, den)
    _, told, _, bunches = _bunched(docs, k, limit, doc_id, text, False)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    links = _links(texts, told, bunches, k, limit, "pairs")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), told.select("doc_id", "node").distinct()


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without near copies: of each group the row with the smallest id stays, and of its texts one.

    Rows of one id with several texts are judged by text, so the id stays as often as it is the least of a group.  Of
    rows of equal id and text one remains.  Documents without words or without an id stay.
    """
    groups = _grouped(docs, k, Threshold(num, den), doc_id, text, False).filter("doc_id is not null")
    rows = keep(groups.groupBy("doc_id", "told", "node", "root").agg(F.count("*").alias("rows")), "rows")
    least = rows.filter("node is not null").groupBy("root").agg(
        F.min_by(F.struct("doc_id", "told", "rows"), F.struct("doc_id", "node", "told")).alias("s")).select("s.*")
    stay = keep(least.unionByName(rows.filter("node is null").select("doc_id", "told", "rows")), "stay").toDF("__id", "__told", "__rows")
    kept = docs.join(stay, (F.col(doc_id).cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__told"))).select(
        *docs.columns, "__told", "__rows")
    alone = docs.filter(F.col(doc_id).isNull())
    if stay.filter("__rows > 1").limit(1).count():
        plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        first = F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("__row")
        several = kept.filter("__rows > 1").groupBy(F.col(doc_id).alias("__id"), "__told").agg(first).select("__row.*")
        kept = kept.filter("__rows = 1").select(*docs.columns).unionByName(several)
    return kept.select(*docs.columns).unionByName(alone)
