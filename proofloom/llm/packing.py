"""Order-preserving packing of documents into sequences by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import encoded, encoder

# Tokens of padding that one cut inside a document is worth: at a sentence's end, and anywhere.
SENTENCE_CUT, HARD_CUT = 8, 64
BUFFER = 1 << 18
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: np.ndarray, penalties: np.ndarray, width: int) -> list[int]:
    """Ends of the windows, as indexes into ``places``, of least padding plus penalties.

    ``places`` ascends from 0 without gaps over ``width``; a window (a, b] costs ``width - (b - a)`` plus the penalty of b.
    Less b, the cost depends on cost(a) + a, so the best a in reach is the head of a queue kept increasing: O(n).
    """
    where, extra = places.tolist(), penalties.tolist()
    cost, back, queue = [0] * len(where), [0] * len(where), deque([(0, 0)])
    for j in range(1, len(where)):
        at = where[j]
        while where[queue[0][1]] < at - width:
            queue.popleft()
        value, back[j] = queue[0]
        cost[j] = value + width - at + extra[j]
        key = cost[j] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(where) - 1
    while j > 0:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def windows(stop: np.ndarray, doc_ends: np.ndarray, width: int) -> np.ndarray:
    """Ends of the windows over a stream: ``stop`` marks tokens that end a sentence, ``doc_ends`` are places."""
    total = len(stop)
    soft = np.flatnonzero(stop) + 1
    places = np.unique(np.concatenate([[0, total], soft, doc_ends]))
    gaps = np.diff(places)
    if (gaps > width).any():  # a sentence longer than a sequence is cut at every width from its start
        wide = np.flatnonzero(gaps > width)
        hard = np.concatenate([np.arange(places[i] + width, places[i + 1], width) for i in wide])
        places = np.union1d(places, hard)
    penalties = np.full(len(places), HARD_CUT)
    penalties[np.isin(places, soft)] = SENTENCE_CUT
    penalties[np.isin(places, doc_ends) | (places == total)] = 0
    return places[best_cuts(places, penalties, width)]


def powers(n: int) -> list[int]:
    """A length as its powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, width: int = 2048, partitions: int | None = None,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents in order of id: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Texts are dealt out by ranges of ids; each task packs its range as one stream, in buffers of
    about ``BUFFER`` tokens whose last window is carried on.  A sequence shorter than ``width`` is padded to it, unless its
    length is a power of two: so the one window left at the end of a range is split into powers of two where that costs
    less than its padding.  ``width`` must be a power of two.  Null and empty texts are the end id alone; equal ids go by text
    and stay documents of their own; other columns are ignored; an empty table has no pieces.  ``sequence_id`` is the
    range's number times 2**40 plus the place in it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
              .repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary).tokenizer
        words = own.decode_batch([[i] for i in range(own.get_vocab_size())], skip_special_tokens=False)
        stops = np.array([w.rstrip(" \"')]").endswith((".", "!", "?")) or "\n" in w for w in words])
        base, made = TaskContext.get().partitionId() << 40, 0
        stream, spans = np.empty(0, "<u4"), []  # spans: doc_id, start in the document, place in the stream, length, doc_tokens

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal stream, spans, made
            starts = np.array([s[2] for s in spans])
            ends = windows(stops[stream], np.array([s[2] + s[3] for s in spans if s[1] + s[3] == s[4]], np.int64), width).tolist()
            if last:
                a = ends[-2] if len(ends) > 1 else 0
                parts = powers(ends[-1] - a)
                if ends[-1] - a < width and width - (ends[-1] - a) > HARD_CUT * (len(parts) - 1):
                    ends[-1:] = (a + np.cumsum(parts)).tolist()
            elif len(ends) > 1:
                ends.pop()
            rows, raw, a = [], stream, 0
            k = 0
            for nr, b in enumerate(ends):
                at = a
                while at < b:
                    while k + 1 < len(spans) and starts[k + 1] <= at:
                        k += 1
                    doc, first, place, length, total = spans[k]
                    to = min(b, place + length)
                    rows.append((doc, first + at - place, to - at, zlib.crc32(raw[at:to].tobytes()), total,
                                 base + made + nr, at - a))
                    at = to
                a = b
            made += len(ends)
            done = ends[-1]
            spans = [(d, f + max(0, done - p), max(p, done) - done, n - max(0, done - p), t)
                     for d, f, p, n, t in spans if p + n > done]
            stream = stream[done:]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in PIECES.split(", ")])

        waiting, n = [], 0
        for doc, ids in encoded(batches, vocabulary, end_id):
            for first in range(0, len(ids), BUFFER):
                part = ids[first:first + BUFFER]
                spans.append((doc, first, len(stream) + n, len(part), len(ids)))
                waiting.append(part)
                n += len(part)
                if len(stream) + n >= BUFFER:
                    stream, waiting, n = np.concatenate([stream, *waiting]), [], 0
                    yield cut(False)
        if len(stream) + n:
            stream = np.concatenate([stream, *waiting])
            yield cut(True)

    return ranged.mapInArrow(run, PIECES)
