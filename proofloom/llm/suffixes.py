"""Removal of repeated passages: every byte covered by a string of ``least`` bytes that also starts earlier.

Equal strings have their smallest hashed piece ("anchor") at the same place, so strings are compared only among the
surroundings of equal anchors that occur more than once.  There, common prefixes come from a Burrows-Wheeler transform:
breadth-first backward extension of intervals sets the prefix lengths 0, 1, 2, ... in turn and stops at ``least``; what is
still unset then is that long or longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keep

PIECE = 32  # bytes of an anchor
PART = 4096  # surroundings of one anchor that one task takes; a commoner anchor is dealt over several
SEGMENT = 1 << 22  # bytes of a text hashed at once
TOGETHER = 1 << 16  # bytes of several short texts hashed at once
ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes from every place on, as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[1]
    return x ^ (x >> np.uint64(29))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the piece at every place, and its upper bits with the place below them."""
    w = _words(data)
    n = max(0, len(w) - PIECE + 8)
    h = w[:n] * ODD[0]
    for i in range(1, 4):
        h += w[8 * i:8 * i + n] * ODD[i]
    h = _mixed(h)
    return h, (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)


def _lows(low: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[:len(low) - (width - reach)], low[width - reach:]) if width > reach else low


def anchors(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest piece, leftmost of equals, of every string of ``least`` bytes."""
    places, width, step = [], least - PIECE + 1, SEGMENT
    hashes = []
    for a in range(0, max(1, len(data) - least + 1), step):
        h, low = _hashed(data[a:a + step + least - 1])
        if len(low) < width:
            continue
        low = _lows(low, width)
        at = low[np.r_[True, low[1:] != low[:-1]]] & np.uint64((1 << 24) - 1)
        at = np.unique(at).astype(np.int64)
        places.append(at + a)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _anchors_of(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of several texts of at least ``least`` bytes: number of the text, place and hash.

    Short texts are hashed as one string, and the strings that cross a border between two are left out.
    """
    found, a, width = [], 0, least - PIECE + 1
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= TOGETHER:
            size += len(texts[b])
            b += 1
        if b == a + 1:
            at, hashes = anchors(texts[a], least)
            found.append((np.full(len(at), a), at, hashes))
        else:
            ends = np.cumsum([len(t) for t in texts[a:b]])
            starts = np.r_[0, ends[:-1]]
            h, low = _hashed(b"".join(texts[a:b]))
            low = _lows(low, width)
            border = np.zeros(len(low) + 1, np.int8)
            border[starts] = 1
            border[ends - least + 1] -= 1
            low = low[np.cumsum(border[:-1], dtype=np.int8).view(bool)]
            at = (low[np.r_[True, low[1:] != low[:-1]]] & np.uint64((1 << 24) - 1)).astype(np.int64)
            own = np.searchsorted(starts, at, "right") - 1
            found.append((own + a, at - starts[own], h[at]))
        a = b
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(text: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Suffix array of strings each ended by a 0 that is unlike all others and smaller than any letter (1 to 256).

    ``owner``: number of the string of each place.  Ranks by 4 letters, then doubled until all differ.
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.int64)
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(4):
        letter = np.where(ended, 0, wide[i:i + n])
        key = key * 512 + letter
        ended |= letter == 0
    key = key * (owner[-1] + 2) + np.where(ended, owner + 1, 0)
    order = np.argsort(key)
    ordered, reach, bits = key[order], 4, int(n).bit_length()
    while True:
        new = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank << bits
        key[:n - reach] += rank[reach:] + 1
        if 3 * bits < 64:  # sorting numbers that hold their place is faster than sorting places
            ordered = np.sort(key << bits | np.arange(n))
            order, ordered = ordered & ((1 << bits) - 1), ordered >> bits
        else:
            order = np.argsort(key)
            ordered = key[order]
        reach *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Per suffix in order: whether it shares ``least`` letters or more with the one before.

    Intervals of suffixes that start with a string are extended by the letter before it.  The end of an interval newly
    reached at length l has a common prefix of l - 1 there; only such intervals are carried on, so each place is set once.
    """
    n = len(text)
    before = text[order - 1]  # the transform; a string's start has the 0 of the string before it
    first = text[order]
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)  # where the suffix one letter longer stands
    unset = np.ones(n + 1, bool)
    starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (first[1:] == 0)])
    ends = np.r_[starts[1:], n]
    unset[starts] = unset[0] = unset[n] = False
    source = np.zeros(n, np.int64)
    live = np.zeros(n, bool)
    for _ in range(1, least):
        if not len(starts):
            break
        width = ends - starts
        number = np.repeat(np.arange(len(starts)), width)
        rows = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + starts[number]
        real = before[rows] != 0
        to, number = back[rows[real]], number[real]
        live[to], source[to] = True, number
        at = np.flatnonzero(live) if len(to) * 8 > n else np.sort(to)
        live[to] = False
        if not len(at):
            break
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (source[at[1:]] != source[at[:-1]]) | (first[at[1:]] != first[at[:-1]])]
        s = np.flatnonzero(new)
        starts, ends = at[s], at[np.r_[s[1:] - 1, len(at) - 1]] + 1
        fresh = unset[ends]
        starts, ends = starts[fresh], ends[fresh]
        unset[ends] = False
    return unset[:n]


def repeated(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of ``least`` letters in the strings: (string, place in it, class of equal ones)."""
    owner = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])
    text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    text[ends] = 0
    order = suffix_order(text, owner)
    group = np.cumsum(~long_prefixes(text, order, least))
    place = order - (np.r_[0, ends[:-1] + 1])[owner[order]]
    room = place + least <= (np.array([len(s) for s in strings]))[owner[order]]
    return owner[order][room], place[room], group[room]


def _string_hashes(data: bytes, places: np.ndarray, least: int) -> np.ndarray:
    """128-bit hashes of the strings of ``least`` bytes at the places, as two columns."""
    w, out = _words(data), []
    offsets = [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])]
    for seed in (1, 2):
        h = np.full(len(places), seed, np.uint64)
        for o in offsets:
            h = _mixed(h * ODD[0] + w[places + o] * ODD[seed + 1])
        out.append(h)
    return np.stack(out, axis=1)


FOUND = "doc long, same long, start long, end long, bucket long, strings binary, count long"


def _runs(docs, sames, places, least) -> np.ndarray:
    """Sorted starts of strings as merged spans, rows of (doc, same, start, end)."""
    order = np.lexsort((places, sames, docs))
    d, s, p = docs[order], sames[order], places[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (p[1:] > p[:-1] + least)][:len(d)]
    a = np.flatnonzero(new)
    b = np.r_[a[1:] - 1, len(d) - 1][:len(a)]
    return np.column_stack([d[a], s[a], p[a], p[b] + least])


def _found(spans: np.ndarray, packed: list[tuple]) -> pa.Table:
    """Spans first, then (bucket, strings, count)."""
    n, m = len(spans), len(packed)
    columns = [pa.concat_arrays([pa.array(spans[:, i], pa.int64()), pa.nulls(m, pa.int64())]) for i in range(4)]
    for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64())):
        columns.append(pa.concat_arrays([pa.nulls(n, kind), pa.array([x[i] for x in packed], kind)]))
    return pa.table(columns, [c.split()[0] for c in FOUND.split(", ")])


def _compare(table: pa.Table, least: int, buckets: int) -> pa.Table:
    """Spans of strings that start earlier among these surroundings.  Where an anchor is dealt over several parts, the
    first of each string goes on, with its hash, to meet the firsts of the other parts."""
    key, doc, same, start = (table.column(c).to_numpy() for c in ("key", "doc", "same", "start"))
    size = pa.compute.binary_length(table.column("content")).to_numpy()
    order = np.lexsort((size, key, start, same, doc))
    key, doc, same, start, size = (x[order] for x in (key, doc, same, start, size))
    # A row stated twice is one.
    once = np.r_[True, np.any([x[1:] != x[:-1] for x in (key, doc, same, start, size)], axis=0)]
    order, key, doc, same, start, size = (x[once] for x in (order, key, doc, same, start, size))
    shared = table.column("parts").to_numpy()[order] > 1
    content = table.column("content").take(pa.array(order)).to_pylist()
    # Equal surroundings need comparing once; all of a later one is repeated.
    kind = dict(zip(reversed(list(zip(key.tolist(), content))), range(len(content) - 1, -1, -1)))
    first = np.array(sorted(kind.values()), np.int64)
    later = np.ones(len(content), bool)
    later[first] = False
    spans = [np.column_stack([doc[later], same[later], start[later], start[later] + size[later]])]
    _, number, kinds = np.unique(key[first], return_inverse=True, return_counts=True)
    at = first[(kinds[number] > 1) | shared[first]]
    packed = []
    if len(at):
        who, place, group = repeated([content[i] for i in at], least)
        d, s, p = doc[at][who], same[at][who], start[at][who] + place
        order = np.lexsort((p, s, d, group))
        d, s, p, group, who, place = (x[order] for x in (d, s, p, group, who, place))
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        lead = np.repeat(head, np.diff(np.r_[head, len(group)]))
        late = (d != d[lead]) | (s != s[lead]) | (p != p[lead])
        spans.append(_runs(d[late], s[late], p[late], least))
        out = head[shared[at[who[head]]]]
        if len(out):
            out = out[np.argsort(who[out], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, who[out][1:] != who[out][:-1], True])
            hashes = np.concatenate([_string_hashes(content[at[who[out[a]]]], place[out[a:b]], least) for a, b in zip(cuts, cuts[1:])])
            rows = np.column_stack([hashes.view(np.int64), d[out], s[out], p[out]])
            bucket = (hashes[:, 0] % np.uint64(buckets)).astype(np.int64)
            rows, bucket = rows[np.argsort(bucket, kind="stable")], np.sort(bucket)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            packed = [(int(bucket[a]), rows[a:b].tobytes(), int(b - a)) for a, b in zip(cuts, cuts[1:])]
    return _found(np.concatenate(spans), packed)


def _meet(table: pa.Table, least: int) -> pa.Table:
    """Spans of strings whose equal started earlier in another part."""
    rows = np.concatenate([np.frombuffer(b.as_buffer(), np.int64).reshape(-1, 5) for b in table.column("strings")])
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    head = np.flatnonzero(new)
    lead = np.repeat(head, np.diff(np.r_[head, len(rows)]))
    late = (rows[:, 2:] != rows[lead, 2:]).any(axis=1)
    return _found(_runs(rows[late, 2], rows[late, 3], rows[late, 4], least), [])


def _anchor_rows(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, hashes = _anchors_of(batch.column("text").cast(pa.binary()).to_pylist(), least)
            sames, keys = batch.column("same").to_numpy()[texts], hashes.view(np.int64)
            for a in range(0, len(keys), 100_000):
                yield pa.record_batch({"key": keys[a:a + 100_000], "same": sames[a:a + 100_000], "place": places[a:a + 100_000]})

    return docs.select("same", "text").mapInArrow(run, "key long, same long, place long")


def _surroundings(texts: DataFrame, least: int) -> DataFrame:
    reach = least - PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column("spots")
            ends, flat = spots.offsets.to_numpy(), spots.flatten()
            key, parts, place = (flat.field(i).to_numpy() for i in range(3))
            ends = ends - ends[0]
            start, texts = np.maximum(0, place - reach), batch.column("text").cast(pa.binary())
            many = np.diff(ends)
            doc, same = (np.repeat(batch.column(c).to_numpy(), many) for c in ("doc", "same"))
            for a in range(0, batch.num_rows, 512):
                b = min(a + 512, batch.num_rows)
                content = []
                for i in range(a, b):
                    data = texts[i].as_py()
                    lo, hi = ends[i], ends[i + 1]
                    content += [data[x:y] for x, y in zip(start[lo:hi].tolist(), (place[lo:hi] + PIECE + reach).tolist())]
                own = slice(ends[a], ends[b])
                yield pa.record_batch([key[own], parts[own], doc[own], same[own], start[own], pa.array(content, pa.binary())],
                                      ["key", "parts", "doc", "same", "start", "content"])

    return texts.mapInArrow(run, "key long, parts long, doc long, same long, start long, content binary")


def repeated_spans(docs: DataFrame, least: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, same, first, spans`` for texts with something to remove.

    ``same`` is a hash of the text, ``first`` the smallest id that has it; later copies are removed whole and have a row
    without spans.  ``spans`` (start, end) in bytes may overlap.  Texts of less than ``least`` bytes have no row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    told = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1 << 63)).alias("doc"), F.col(text).alias("text"))
    told = told.filter(F.octet_length("text") >= least).withColumn("same", F.xxhash64("text"))
    marks = told.select("same", "doc", F.md5(F.encode("text", "UTF-8")).alias("m")).groupBy("same").agg(
        F.min("doc").alias("first"), F.min("m").alias("m0"), F.max("m").alias("m1"))
    clash = F.raise_error(F.lit("two texts have one 64-bit hash")).cast("long")
    firsts = keep(marks.select("same", F.when(F.col("m0") == F.col("m1"), F.col("first")).otherwise(clash).alias("first")), "firsts")
    seen = _anchor_rows(told, least)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("same", "place") for f in (F.min, F.max)]
    shared = keep(seen.groupBy("key").agg(*ends, F.count("*").alias("n"))
                  .filter("min_same < max_same or min_place < max_place").select("key", F.ceil(F.col("n") / PART).alias("parts")), "shared")
    spots = keep(seen.join(shared, "key").groupBy("same").agg(F.collect_set(F.struct("key", "parts", "place")).alias("spots"))
                 .join(firsts, "same"), "spots")
    texts = told.join(spots.select(F.col("first").alias("doc"), "same", "spots"), ["doc", "same"])
    around = _surroundings(texts, least)
    size = spots.agg(F.sum(F.size("spots"))).first()[0] or 0
    buckets = max(1, -(-size // PART))
    many = F.col("parts") > 1
    units = around.select("*", F.when(many, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).alias("unit"),
                          F.when(many, F.pmod(F.xxhash64("doc", "same"), F.col("parts"))).otherwise(F.lit(-1)).alias("part"))
    found = keep(units.groupBy("unit", "part").applyInArrow(lambda t: _compare(t, least, buckets), FOUND), "found")
    met = found.filter("strings is not null").select("bucket", "strings").groupBy("bucket").applyInArrow(lambda t: _meet(t, least), FOUND)
    all_ = found.filter("strings is null").unionByName(keep(met, "met")).groupBy("doc", "same").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    return keep(told.select("doc", "same").distinct().join(firsts, "same").join(all_, ["doc", "same"], "left")
                .filter("spans is not null or doc > first"), "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``__spans`` (null: nothing, one whole span for a copy) to documents."""
    own = docs.withColumn("__doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(-1 << 63))).withColumn("__same", F.xxhash64(text))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1 << 62).alias("end")))
    told = spans.select(F.col("doc").alias("__doc"), F.col("same").alias("__same"),
                        F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("spans")).alias("__spans"))
    return own.join(told, ["__doc", "__same"], "left").drop("__doc", "__same")


def removed_bytes(docs: DataFrame, least: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document.

    Earlier is a smaller id, in one document an earlier start; a null id comes before all; equal ids go by a hash
    of the text, and rows of equal id and text are one document and get equal rows.  A null text is empty.
    """
    spans = repeated_spans(docs, least, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, s in zip(batch.column(0), batch.column(1), batch.column(2)):
                data, spans = (t.as_py() or "").encode(), s.as_py() or []
                cut = merged([(x["start"], min(x["end"], len(data))) for x in spans])
                keeps, at = hashlib.sha256(), 0
                for a, b in cut:
                    keeps.update(data[at:a])
                    at = b
                keeps.update(data[at:])
                rows.append((i.as_py(), len(data), sum(b - a for a, b in cut), len(cut), keeps.hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                                  ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_spans(own, spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, least: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with repeated passages cut out of ``text``; whole characters only, so a span loses the bytes of a character
    it holds in part.  All rows stay; a text of which nothing is left is empty, and a null text stays null."""
    bounded_batches(docs.sparkSession)
    spans, names = repeated_spans(docs, least, doc_id, text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, s in zip(batch.column(text), batch.column("__spans")):
                if s.is_valid and t.is_valid:
                    data, out, at = t.as_py().encode(), [], 0
                    for a, b in merged([(x["start"], min(x["end"], len(data))) for x in s.as_py()]):
                        while a < b and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        out.append(data[at:a])
                        at = b
                    texts.append(b"".join([*out, data[at:]]).decode())
                else:
                    texts.append(t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names)

    return with_spans(docs, spans, doc_id, text).mapInArrow(run, docs.schema)
