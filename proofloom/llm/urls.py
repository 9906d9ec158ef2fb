"""URL rules by a cascade of Bloom filters.

Level 0 holds the listed keys, level 1 those keys of the corpus that level 0 holds wrongly, level 2 the
listed keys that level 1 holds wrongly, and so on until a level makes no mistake.  Because the levels were
tried on every key the corpus has, membership is exact for it, and pages are judged without a join.  A list whose
filters are too large for a task is judged slice by slice of its keys.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep

# Rules are judged in slices whose cascades take about so many bytes; a longer list takes more passes over the pages.
SLICE_BYTES = 64 << 20
# Bytes of a filter that one task puts together.
BLOCK = 1 << 18


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or
    end.  Null or no ``://``: both empty."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of rules that could fit: each domain above or equal the host, each path start of a listed length.
    Longest first; of equal length, the longer host."""
    found, at = [], 0
    while host:
        found += [(host[at:], path[:n]) for n in lengths if n <= len(path)]
        at = host.find(".", at) + 1
        if not at:
            break
    return [h + p if p.startswith("/") or not p else h + " " + p
            for h, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def bits_of(key: str, level: int, m: int, k: int) -> list[int]:
    """Places of a key in a filter of ``m`` bits."""
    x = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), seed=level)
    a, b = x >> 64, (x & (1 << 64) - 1) | 1
    return [(a + i * b) % m for i in range(k)]


def holds(levels: list[tuple[int, int, bytes]], key: str) -> bool:
    """Exact membership: the first level that lacks the key tells, by its parity, whether it is listed."""
    for i, (m, k, data) in enumerate(levels):
        if not all(data[p >> 3] >> (p & 7) & 1 for p in bits_of(key, i, m, k)):
            return i % 2 == 1
    return len(levels) % 2 == 1


def _level(keys: DataFrame, n: int, number: int, rate: float) -> tuple[int, int, bytes]:
    """One filter over ``keys(key)``.  Bits are set by tasks and joined in blocks, so what reaches the driver is the filter, a row per block."""
    m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    k = max(1, round(m / max(n, 1) * math.log(2)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [p for key in batch.column(0).to_pylist() for p in bits_of(key, number, m, k)]
            yield pa.record_batch({"at": pa.array([p >> 3 for p in bits], pa.int64()),
                                   "bit": pa.array([1 << (p & 7) for p in bits], pa.int32())})

    def block(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        data = np.zeros(min(BLOCK, (m + 7) // 8 - number * BLOCK), np.uint8)
        data[table.column("at").to_numpy() - number * BLOCK] = table.column("bits").to_numpy()
        return pa.table({"block": [number], "data": pa.array([data.tobytes()], pa.binary())})

    # A byte is one row from here on, so a block has at most BLOCK rows.
    bits = keys.mapInArrow(places, "at long, bit int").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    blocks = bits.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("block").applyInArrow(block, "block long, data binary")
    data = bytearray((m + 7) // 8)
    for row in blocks.toLocalIterator():
        data[row.block * BLOCK:row.block * BLOCK + len(row.data)] = row.data
    return m, k, bytes(data)


def _held(keys: DataFrame, level: tuple[int, int, bytes], number: int) -> DataFrame:
    m, k, data = level

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([all(data[p >> 3] >> (p & 7) & 1 for p in bits_of(key, number, m, k))
                                         for key in batch.column(0).to_pylist()], pa.bool_()))

    return keys.mapInArrow(test, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame, name: str) -> list[tuple[int, int, bytes]]:
    """Levels for ``listed(key)`` exact over ``universe(key)``; both distinct.

    The first level's error rate leaves about as many wrong keys as there are listed ones, so all levels
    together take space by the listed keys and the logarithm of the universe.
    """
    # A key outside the corpus is never asked for, but costs only bits.
    own = keep(listed.select("key"), f"{name}-listed")
    rest = keep(universe.select("key").join(own, "key", "left_anti"), f"{name}-rest")
    n, other, levels = own.count(), rest.count(), []
    rate = min(0.5, max(n, 1) / max(other, 1) / math.sqrt(2))
    while n:
        level = _level(own, n, len(levels), rate)
        wrong = keep(_held(rest, level, len(levels)), f"{name}-{len(levels)}")
        levels.append(level)
        own, rest, n, rate = wrong, own, wrong.count(), 0.5
    return levels


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to pages.

    ``rules``: ``host, path, verdict`` (allow or block).  A rule fits its host and all subdomains where the
    path starts with the rule's; the longest wins, of equal length the one with the longer host.  A key listed with both
    verdicts blocks.  A rule whose host or verdict is null, or whose host is empty, fits nothing; a null path is the
    empty one.  Urls without ``://`` or null have empty host and path and no rule.  No rule fits: ``default``.  Input
    columns named like the four are replaced; an empty table gives an empty result.
    """
    rules = rules.filter("host <> '' and verdict is not null").select(
        F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    joint = F.when(F.col("path").startswith("/") | (F.col("path") == ""), F.lit("")).otherwise(F.lit(" "))
    rules = keep(rules.groupBy(F.concat("host", joint, "path").alias("key")).agg(
        F.max("verdict").alias("verdict"), F.max(F.length("path")).alias("n")), "rules")
    lengths = sorted(r.n for r in rules.select("n").distinct().toLocalIterator())
    host, path = host_and_path(pages[url])
    parsed = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
                          host.alias("host"), path.alias("path"))
    spots = parsed.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": pa.array([k for h, p in zip(*(c.to_pylist() for c in batch.columns))
                                                    for k in dict.fromkeys(keys_of(h, p, lengths))], pa.string())})

    universe = keep(spots.mapInArrow(keys, "key string").distinct(), "universe")
    # Bytes of a cascade: the first level by the logarithm of the universe, about 3 bits a key for the others.
    listed, asked = rules.count(), universe.count()
    size = listed * (1.44 * math.log2(max(2, 2 * asked / max(listed, 1))) + 3) / 8
    slices = max(1, math.ceil(size / SLICE_BYTES))
    rules, universe = (t.withColumn("slice", F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(slices))) for t in (rules, universe))
    judged = parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    for n in range(slices):
        own = rules.filter(F.col("slice") == n)
        cascades = {v: build_cascade(own.filter(F.col("verdict") == v), universe.filter(F.col("slice") == n), v)
                    for v in ("block", "allow")}
        judged = _judged(judged, cascades, lengths, n, slices)
        # One slice is judged at a time, so a task never holds the filters of two.
        judged = keep(judged, "judged") if n + 1 < slices else judged
    return judged


def _judged(pages: DataFrame, cascades: dict[str, list[tuple[int, int, bytes]]], lengths: list[int], number: int,
            slices: int) -> DataFrame:
    """Pages with the better of the rule they have and the first of their keys that a cascade holds.

    A cascade is exact for keys of its own slice, so only these are asked for.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict, seen = [], [], {}
            for host, path, had, was in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "rule", "verdict"))):
                spot = host, path, had
                if spot not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    # Keys come best first; those after the rule already found are worse.
                    keys = keys_of(host, path, lengths)
                    better = [k for k in (keys[:keys.index(had)] if had is not None else keys)
                              if slices == 1 or zlib.crc32(k.encode("utf-8", "surrogatepass")) % slices == number]
                    seen[spot] = next(((k, v) for k in better for v in cascades if holds(cascades[v], k)), (had, was))
                rule.append(seen[spot][0])
                verdict.append(seen[spot][1])
            columns = {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return pages.mapInArrow(judge, pages.schema)
