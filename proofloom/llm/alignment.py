"""Alignment of two tokenizers over the same bytes: common token ends, groups between them and overlapping pairs.

The ends of a unit's tokens are two increasing lists.  The shorter one drives: each of its ends is sought in the longer by
doubling steps and then halving, from where the last search stopped.  Ends in both lists cut the tokens into groups;
the rank of an end in the other list tells which of its tokens a token overlaps.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, keep
from .tokens import SIGNS

UNIT = re.compile(r"(?<=\S)(?= \S)")  # both vocabularies start a token at a single blank between visible characters
BESIDE_BLANK = re.compile(r"\s | \s")
MEMO, BUNDLE = 600_000, 8 << 20
DIGITS = 40  # bits of a count within the sum of counts of a text
PIECE_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def gallop(ends: Sequence[int], value: int, low: int) -> int:
    """The first place at or behind ``low`` whose end is ``value`` or more: doubling steps, then halving."""
    n, step, high = len(ends), 1, low
    while high < n and ends[high] < value:
        low = high + 1
        high += step
        step *= 2
    high = min(high, n)
    while low < high:
        mid = (low + high) // 2
        if ends[mid] < value:
            low = mid + 1
        else:
            high = mid
    return low


def overlaps(short: Sequence[int], long: Sequence[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(groups, ranges) of two increasing lists of ends over the same bytes.

    ``groups`` holds, per common end, how many tokens of each list lie before it.  ``ranges`` holds, per token of ``short``, the
    first and last token of ``long`` that it overlaps: the difference of the ranks of its two ends.
    """
    groups, ranges, first, at = [], [], 0, 0
    for i, end in enumerate(short):
        at = gallop(long, end, at)
        ranges.append((first, at))
        if long[at] == end:
            groups.append((i + 1, at + 1))
            first = at + 1
        else:
            first = at
    return groups, ranges


class Aligner:
    """Tokens of a unit (a blank and what follows it, up to the next cut) by both tokenizers, aligned."""

    def __init__(self, bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(bpe)
        self.a.encode_special_tokens = True  # their strings in a text are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        sign = {c: b for b, c in SIGNS.items()}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode()
                        for t in map(self.a.id_to_token, range(size))]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := PIECE_BYTE.fullmatch(t)) else t.replace("▁", " ").encode()
                        for t in map(self.b.id_to_piece, range(self.b.get_piece_size()))]
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.memo: dict[str, tuple | None] = {}

    def units(self, text: str) -> list[str]:
        """The text behind a blank, cut at single blanks between visible characters."""
        if text[0] != " " and not text[-1].isspace() and not BESIDE_BLANK.search(text):
            return [" " + w for w in text.split(" ")]
        return UNIT.split(" " + text)

    def _a_ids(self, unit: str) -> list[int]:
        word = unit[1:]
        if word.isalpha():  # with its blank, one token of the pre-tokenizer
            signs = "Ġ" + word if word.isascii() else "".join(map(SIGNS.__getitem__, unit.encode()))
            return [t.id for t in self.a.model.tokenize(signs)]
        return self.a.encode(unit, add_special_tokens=False).ids

    def align(self, unit: str) -> tuple[int, bytes, str] | None:
        """(counts of tokens of A, tokens of B and groups in one number, linked id pairs, groups as text); None where bytes differ.

        A pair is A's id times 2**16 plus B's id, as a little-endian unsigned 64-bit integer.
        """
        a, b, raw = self._a_ids(unit), self.b.encode(unit[1:]), unit.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a_ends, b_ends = list(accumulate(map(self.a_size.__getitem__, a))), list(accumulate(map(self.b_size.__getitem__, b)))
        if len(a) <= len(b):
            groups, ranges = overlaps(a_ends, b_ends)
            pairs = array("Q", [(x << 16) + y for x, (p, q) in zip(a, ranges) for y in b[p:q + 1]])
        else:
            swapped, ranges = overlaps(b_ends, a_ends)
            groups = [(i, j) for j, i in swapped]
            pairs = array("Q", [(x << 16) + y for y, (p, q) in zip(b, ranges) for x in a[p:q + 1]])
        told, i, j = [], 0, 0
        for to_i, to_j in groups:
            told.append(f"{','.join(map(str, a[i:to_i]))}|{','.join(map(str, b[j:to_j]))}")
            i, j = to_i, to_j
        return (len(a) << 2 * DIGITS) + (len(b) << DIGITS) + len(groups), pairs.tobytes(), ";".join(told)

    def document(self, text: str | None) -> tuple[int, bytes, str] | None:
        """``align`` of a whole text; None for texts without tokens."""
        if not text:
            return None
        parts, memo = [], self.memo
        for unit in self.units(text):
            if unit in memo:
                part = memo[unit]
            else:
                part = self.align(unit)
                if len(memo) < MEMO and len(unit) < 64:
                    memo[unit] = part
            if part is None:
                return None
            parts.append(part)
        counts, pairs, told = zip(*parts)
        return sum(counts), b"".join(pairs), ";".join(told)


@functools.cache
def aligner(bpe: str, pieces: str) -> Aligner:
    """One aligner per worker and pair of vocabularies."""
    return Aligner(bpe, pieces)


FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "cells")
DOC = pa.struct([*[(f, pa.int64()) for f in FIELDS], ("groups_sha256", pa.string())])
BUNDLE_SCHEMA = pa.schema([("bundle", pa.string()), ("docs", pa.list_(DOC)), ("cells", pa.binary()),
                           ("pairs", pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())])))])
BUNDLES = (f"bundle string, docs array<struct<{', '.join(f'{f}: bigint' for f in FIELDS)}, groups_sha256: string>>, cells binary, "
           "pairs array<struct<pair: bigint, n: bigint>>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _bundle(name: str, ids: list, aligned: list) -> pa.RecordBatch:
    """Documents of one bundle: each one's distinct pairs as places in the bundle's sorted list of pairs, and how often."""
    own, docs = [], []
    for i, part in zip(ids, aligned):
        sums, raw, told = part or (0, b"", "")
        n_a, n_b, n_groups = (sums >> bits & (1 << DIGITS) - 1 for bits in (2 * DIGITS, DIGITS, 0))
        codes, count = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
        own.append((codes, count))
        docs.append({"doc_id": i, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": len(raw) // 8,
                     "groups_sha256": hashlib.sha256(told.encode()).hexdigest() if part else "", "cells": len(codes)})
    codes, counts = np.concatenate([c for c, _ in own]), np.concatenate([n for _, n in own])
    pairs, place = np.unique(codes, return_inverse=True)
    total = np.bincount(place, counts, len(pairs)).astype(np.int64)
    cells = zstandard.compress(place.astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 1)
    listed = pa.StructArray.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(total)], ["pair", "n"])
    return pa.record_batch([pa.array([name]), pa.array([docs], pa.list_(DOC)), pa.array([cells], pa.binary()),
                            pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), listed)], schema=BUNDLE_SCHEMA)


def align(docs: DataFrame, bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text", bundle: int = BUNDLE) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A is the byte-level tokenizer ``bpe`` over a blank and the text, B the sentence-piece model ``pieces`` over the text.  A
    link is a pair of tokens that share bytes; a pair of ids counts how many links of the corpus hold it; ``n_best`` counts
    links whose pair is the most frequent of its B id, ties included; ``count_sum`` sums the counts over the links.
    Texts that are null, empty, or whose tokens do not give back the text have no tokens and an empty hash.  Repeated
    rows are documents of their own; a null id stays; other columns are ignored; an empty table gives no rows.

    Documents are aligned once and kept in bundles of about ``bundle`` characters.  A bundle states each of its pairs once,
    so the join with the counts holds one row per bundle and pair, and no pair is hotter than there are bundles.
    """
    bounded_batches(docs.sparkSession)
    told = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, nr = aligner(bpe, pieces), TaskContext.get().partitionId(), 0
        ids, aligned, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                ids.append(i)
                aligned.append(own.document(t))
                size += len(t or "")
                if size >= bundle or len(ids) >= 10_000:
                    yield _bundle(f"{part}-{nr}", ids, aligned)
                    ids, aligned, size, nr = [], [], 0, nr + 1
        if ids:
            yield _bundle(f"{part}-{nr}", ids, aligned)

    bundles = keep(told.mapInArrow(run, BUNDLES), "aligned")
    stated = bundles.select("bundle", F.inline("pairs"))
    counts = stated.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFF))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = stated.select(F.col("bundle").alias("of"), "pair").join(judged, "pair")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        out = []
        for row in left.select(["docs", "cells"]).to_pylist():
            flat = np.frombuffer(zstandard.decompress(row["cells"]), "<u4")
            place, n = np.split(flat.astype(np.int64), 2)
            at = 0
            for d in row["docs"]:
                p, k = place[at:at + d["cells"]], n[at:at + d["cells"]]
                at += d["cells"]
                out.append({**{f: v for f, v in d.items() if f != "cells"}, "n_best": int(k[best[p]].sum()), "count_sum": int((k * count[p]).sum())})
        names = [f.split()[0] for f in RESULT.split(", ")]
        return pa.table({f: pa.array([r[f] for r in out], pa.string() if f == "groups_sha256" else pa.int64()) for f in names})

    return (bundles.select("bundle", "docs", "cells").groupBy("bundle").cogroup(known.groupBy("of"))
            .applyInArrow(finish, RESULT))
