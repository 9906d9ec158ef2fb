"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces

TOKEN = re.compile(r"\w+|[^\w\s]+")
MIX, SAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


@dataclass
class Model:
    """Weights by hashed n-gram and a bias."""

    bits: int
    scale: float
    bias: float
    weights: np.ndarray


def ngrams(text: str | None, bits: int) -> np.ndarray:
    """Slots of all words and pairs of neighbouring words of a whole text, repeats kept.  Words and runs of other
    signs are tokens; a token repeated at once or over one other gives one and the same slot, whatever it is."""
    found, last = [], None
    for piece in pieces(text or ""):
        tokens = TOKEN.findall(piece)
        if not tokens:
            continue
        one = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        all_ = one if last is None else np.concatenate([last, one])
        two = np.where(all_[1:] == all_[:-1], SAME, (all_[:-1] * MIX) ^ (all_[1:] + SAME)) * MIX
        again = np.full(int((all_[2:] == all_[:-2]).sum()), SAME) if len(all_) > 2 else two[:0]
        found += [x >> np.uint64(64 - bits) for x in (one, two, again)]
        last = one[-1:]
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def counted(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and how often each occurs."""
    at, count = np.unique(slots, return_counts=True)
    return at.astype(np.int32), count.astype(np.int32)


def train_ftrl(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], bits: int, scale: float, epochs: int = 4, alpha: float = 0.3,
               beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """Follow-the-regularised-leader (proximal) over (counted slots, label) in the given order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last slot is the bias
    sparse = []
    for (at, count), label in rows:
        sparse.append((np.append(at, 1 << bits), np.append(count * (scale / max(1, count.sum())), 1.0), label))

    def weights(zi, ni):
        return np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, x, label in sparse:
            w = weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(z, n)
    return Model(bits, scale, float(w[-1]), w[:-1].astype(np.float32))


def score(model: Model, text: str | None) -> float:
    """Probability of label 1: the sparse dot product of n-gram shares and weights, squashed."""
    slots = ngrams(text, model.bits)
    dot = float(model.weights[slots].sum(dtype=np.float64)) * model.scale / max(1, len(slots)) + model.bias
    return float(1 / (1 + np.exp(-np.clip(dot, -35, 35))))


def fold(doc_id: Column, folds: int = 4) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, max_rows: int = 8192, bits: int = 18,
        scale: float = 20.0) -> Model:
    """Fits on at most ``max_rows`` labelled documents outside the held-out fold: those whose hashed id comes first.

    ``labels``: ``doc_id, quality``; other labels than 0 and 1 and null ids are passed over, and of several for one
    id the lower counts.  Texts of the bounded sample meet in one task, which returns only the weights.  With no labelled
    row the model is a constant 0.5.
    """
    bounded_batches(docs.sparkSession)
    told = (labels.filter("quality in (0, 1) and doc_id is not null").filter(fold(F.col("doc_id")) != held_out)
            .groupBy("doc_id").agg(F.min("quality").cast("int").alias("__y")))
    told = told.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", "doc_id").limit(max_rows)
    # The sample is bounded by max_rows ids, so it may be sent to all tasks.
    some = docs.select("doc_id", "text").join(F.broadcast(told), "doc_id").repartition(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("__h", "doc_id", "text", "__y")]
            rows += [(h, i, xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")), counted(ngrams(t, bits)), y)
                     for h, i, t, y in zip(*cols)]
        rows.sort(key=lambda r: r[:3])  # the order must not depend on how rows arrived
        model = train_ftrl([r[3:] for r in rows], bits, scale)
        yield pa.record_batch({"bias": [model.bias], "weights": pa.array([model.weights.tobytes()], pa.binary())})

    rows = some.mapInArrow(train, "bias double, weights binary").collect()
    if not rows:
        return Model(bits, scale, 0.0, np.zeros(1 << bits, np.float32))
    return Model(bits, scale, rows[0].bias, np.frombuffer(rows[0].weights, np.float32))


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """Adds the score of every whole text; null and empty texts get the bias alone.

    A column of that name is replaced.  The model has a fixed size of 4 * 2**bits bytes and is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    rest = docs.drop(name)
    columns = [c for c in rest.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = pa.array([score(own, t.as_py()) for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], scores], [*columns, name])

    return rest.mapInArrow(run, rest.select(*columns).schema.add(name, "double"))
