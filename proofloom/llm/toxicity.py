"""Toxicity of texts after deobfuscation by a noisy channel.

A disguised word ("1d10t", "i d i o t", "idiooot") spans a lattice: a sign may stand for a letter, a run for one or two of
its letter, a separator for nothing.  The path of highest probability under a character language model and the costs of the
channel is the restored text.  The language model counts runs of four characters over all documents.  Restored words and
their beginnings are then scored by how much more often they occur in toxic documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, keep
from .quality import fold

# The letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = frozenset(" .-_*'/~,")
# Costs of the channel in nats: a sign read as a letter, a sign inside a word read as itself, a separator dropped,
# a letter dropped from a run of three and more, and from a pair.
SUBSTITUTE, SIGN_KEPT, SEPARATOR_DROPPED, REPEAT_DROPPED, DOUBLE_DROPPED = 0.7, 4.0, 0.7, 0.3, 1.5

# Classes of the language model: 0 what is no letter, 1-26 a-z, 27 any other letter.
SYMBOLS, ORDER = 28, 4
CELLS = SYMBOLS ** ORDER
START = np.zeros(ORDER - 1, np.int64)
BACKOFF = 5.0
BYTE_CLASS = np.zeros(256, np.int64)
BYTE_CLASS[97:123] = BYTE_CLASS[65:91] = np.arange(1, 27)
BYTE_CLASS[0xC3:0xF5] = 27  # first bytes of other letters; 0x80-0xBF, bytes behind these, are passed over
BYTE_CLASS[0xC2] = BYTE_CLASS[0xE2] = 0  # signs of Latin 1 and general punctuation

LETTERS = re.compile(r"[^\W\d_]+")
# What surrounds a word: signs before it, and behind it (read from the end) signs, exclamation marks or one sign three times.
EDGE = [re.compile(p) for p in (r"[^\w$@€£]*", r"[^\w$@!]*", r"!*", r"(?:([^\w])\1{2,})?")]
TRIPLE = re.compile(r"([^\W\d_])\1\1|([^\W\d_])\2\w*([^\W\d_])\3")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*]{1,2}[^\W_@$!]|[ .\-_*]{1,2}[@$!]){2,}(?![^\W_])")
# Signs around a word that are never part of a disguise, and a letter that stands twice.
AROUND = ".,;:?()\"'"
DOUBLED = re.compile(r"(.)\1", re.S)
PREFIXES = range(3, 7)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
MEMO = 200_000


def byte_counts(texts: Iterator[bytes]) -> np.ndarray:
    """Counts of all runs of ``ORDER`` classes in UTF-8 texts; what is no letter counts as one boundary, however long."""
    total, before = np.zeros(CELLS, np.int64), START
    waiting, size = [], 0
    for raw in texts:
        waiting.append(b" ")
        # A long text is counted 1 MB at a time; the classes before a cut go on behind it.
        for at in range(0, len(raw), 1 << 20):
            waiting.append(raw[at:at + (1 << 20)])
            size += len(waiting[-1])
            if size >= 1 << 22:
                ended = at + (1 << 20) >= len(raw)
                found, last = _counted(b"".join(waiting) + b" " * ended, before)
                total += found
                waiting, size, before = [], 0, START if ended else last
    return total + _counted(b"".join(waiting) + b" ", before)[0]


def _counted(raw: bytes, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the runs that end in ``raw``, the classes ``before`` standing before it, and the last classes of both."""
    seen = np.frombuffer(raw, np.uint8)
    kinds = np.concatenate([before, BYTE_CLASS[seen[(seen & 0xC0) != 0x80]]])
    own = kinds[ORDER - 1:]
    kinds = np.concatenate([before, own[(own != 0) | (kinds[ORDER - 2:-1] != 0)]])
    code = np.zeros(len(kinds) - ORDER + 1, np.int64)
    for k in range(ORDER):
        code = code * SYMBOLS + kinds[k:len(kinds) - ORDER + 1 + k]
    return np.bincount(code, minlength=CELLS), kinds[1 - ORDER:]


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log probability of a class behind the three before it, each order backed off to the shorter one."""
    told, p = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64), np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        n = told.sum(axis=tuple(range(ORDER - order)))
        p = (n + BACKOFF * p) / (n.sum(axis=-1, keepdims=True) + BACKOFF)
    return np.log(p).reshape(-1)


def kind_of(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 if c.isalpha() else 0


def edges(token: str) -> tuple[str, str, str]:
    """A token's signs before, its core and its signs behind, in one pass from either end however long it is."""
    before, *behind = EDGE
    start = before.match(token).end()
    back = token[:start - 1 if start else None:-1]
    end = len(token) - max(p.match(back).end() for p in behind)
    return token[:start], token[start:end], token[end:]


class Restorer:
    """Restores texts under one language model."""

    def __init__(self, log_p: np.ndarray):
        self.log_p = log_p.tolist()
        self.memo: dict[str, tuple[str, tuple[str, ...]]] = {}

    def decode(self, span: str) -> str:
        """The likeliest reading of a lower-case span: Viterbi over its lattice, states being the last three classes.

        Its time grows with its length; behind the place reached, only nodes that some reading still uses are kept.
        """
        n, log_p = len(span), self.log_p
        # Per place: state -> (cost, back pointer, what was written).
        at: list[dict[int, tuple] | None] = [{} for _ in range(n + 2)]
        at[0][0] = (0.0, None, "")
        # How many equal characters stand from each place on.
        runs = [1] * (n + 1)
        for i in range(n - 2, -1, -1):
            if span[i] == span[i + 1]:
                runs[i] = runs[i + 1] + 1

        def go(node, state: int, to: int, cost: float, kind: int, text: str) -> None:
            # A boundary behind a boundary is the same one.
            if kind or state % SYMBOLS:
                code = state * SYMBOLS + kind
                cost -= log_p[code]
                state = code % (CELLS // SYMBOLS)
            cost += node[0]
            known = at[to].get(state)
            if known is None or cost < known[0]:
                at[to][state] = (cost, node, text)

        for i in range(n):
            c = span[i]
            if not at[i]:
                continue
            beside = i > 0 and span[i - 1].isalnum() or i + 1 < n and span[i + 1].isalnum()
            run = runs[i] if c.isalpha() else 1
            for state, node in at[i].items():
                if c.isalpha():
                    go(node, state, i + 1, 0.0, kind_of(c), c)
                    # From the second letter of a run its rest may be dropped; doubled letters are common.
                    if run > 1:
                        go(node, state, i + run, DOUBLE_DROPPED if run == 2 else REPEAT_DROPPED * (run - 1), kind_of(c), c)
                else:
                    go(node, state, i + 1, SIGN_KEPT if c in LEET and beside else 0.0, 0, c)
                    for letter in LEET.get(c, ""):
                        go(node, state, i + 1, SUBSTITUTE, kind_of(letter), letter)
                    if c in SEPARATORS and 0 < i < n - 1:
                        cost = node[0] + SEPARATOR_DROPPED
                        known = at[i + 1].get(state)
                        if known is None or cost < known[0]:
                            at[i + 1][state] = (cost, node, "")
            at[i] = None
        for state, node in at[n].items():
            go(node, state, n + 1, 0.0, 0, "")
        node, told = min(at[n + 1].values(), key=lambda x: x[0]), []
        while node:
            told.append(node[2])
            node = node[1]
        return "".join(reversed(told))

    def token(self, token: str) -> tuple[str, tuple[str, ...]]:
        """A token without white space restored, and its words."""
        known = self.memo.get(token)
        if known is None:
            bare = token.strip(AROUND)
            if bare.isalpha() and not (DOUBLED.search(bare) and TRIPLE.search(bare)):
                known = token, (bare,)
            else:
                head, core, tail = edges(token)
                plain = core.isalpha() and not TRIPLE.search(core)
                # Signs alone have no other reading.
                read = core if plain or not LETTERS.search(core) else self.decode(core)
                known = head + read + tail, tuple(LETTERS.findall(read))
            if len(self.memo) < MEMO and len(token) < 64:
                self.memo[token] = known
        return known

    def _joined(self, text: str) -> str:
        return SPACED.sub(lambda m: self.decode(m[0]), text.lower())

    def restore(self, text: str | None) -> str | None:
        """The whole text, lower-cased, with disguised words restored; white space between tokens stays."""
        return None if text is None else re.sub(r"\S+", lambda m: self.token(m[0])[0], self._joined(text))

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text."""
        memo, token = self.memo.get, self.token
        return {w for t in set(self._joined(text or "").split()) for w in (memo(t) or token(t))[1]}


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word + "$", *[word[:k] for k in PREFIXES if k <= len(word)]]


def smallest_shingles(text: str) -> tuple[int, int]:
    """The smallest three-word shingle under each of two hashes; near copies mostly agree on both."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), np.uint64)
    if len(h) > 2:
        h = (h[:-2] * MIX[0] ^ h[1:-1]) * MIX[1] ^ h[2:]
    least = [int(((h * m) ^ (h >> np.uint64(29))).min(initial=np.uint64(2 ** 64 - 1))) >> 1 for m in MIX]
    return least[0], least[1]


@dataclass
class Model:
    """Base rate of label 1, evidence by feature, and the language model.

    ``table`` (feature, e) holds the evidence instead where it is too much for each task to hold.
    """

    base: float
    evidence: dict[str, float]
    log_p: np.ndarray
    known: dict[str, float] = field(default_factory=dict)
    table: DataFrame | None = None

    def __post_init__(self):
        # First letters of all features: a word with others has no evidence.
        self.starts = {f.removesuffix("$")[:PREFIXES[0]] for f in self.evidence}

    def word(self, word: str) -> float:
        """The strongest evidence among a word's features; 0 if none counts."""
        told = self.known.get(word)
        if told is None:
            told = max((self.evidence.get(f, 0.0) for f in features(word)), default=0.0)
            if len(self.known) < MEMO:
                self.known[word] = told
        return told

    def prior(self) -> float:
        return math.log(self.base / (1 - self.base))

    def score(self, words: set[str]) -> float:
        """Probability of label 1: the base rate's log odds and the evidence of all distinct words."""
        # Sorted, so the sum does not depend on the order of a set.
        starts, k = self.starts, PREFIXES[0]
        odds = self.prior() + sum(sorted([e for w in words if w[:k] in starts and (e := self.word(w))]))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities from the characters of all documents: ``28**4`` cells, whatever the size of the corpus."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = byte_counts(t.as_py() for b in batches for t in b.column(0))
        at = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    raw = docs.select(F.col(text).cast("binary").alias("t")).filter("t is not null")
    cells = raw.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CELLS, np.int64)
    told = cells.toArrow()  # one row per cell: bounded by the size of the alphabet
    counts[told.column("cell").to_numpy()] = told.column("n").to_numpy()
    return log_probabilities(counts)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, max_features: int = 65_536, least_share: float = 0.9,
        chance: float = 1.0) -> Model:
    """Counts features over all labelled documents outside the held-out fold.

    ``labels``: ``doc_id, toxic``; other labels than 0 and 1 and null ids are passed over, and of several for one id the higher
    counts.  A feature counts if at least ``least_share`` of its documents are toxic, and if chance at the base rate would
    give at most ``chance`` such features among all (Chernoff's bound).  Up to ``max_features`` of these are held by each task;
    more stay a table that words are joined with, so none is left out.  A feature must also be among the commonest of some toxic document (half as common as its commonest,
    or more): words that merely stand beside a telling one in a group of near copies add nothing.  Texts that share their
    smallest shingle under two hashes, as copies do, count once.  Without labelled rows the model is a constant 0.1.
    """
    spark = docs.sparkSession
    log_p = language_model(docs)
    told = (labels.filter("toxic in (0, 1) and doc_id is not null").filter(fold(F.col("doc_id")) != held_out)
            .groupBy("doc_id").agg(F.max("toxic").cast("long").alias("__y")))
    sent = spark.sparkContext.broadcast(log_p)
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [smallest_shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                              batch.column("y"), batch.column("text")], ["h", "s", "y", "text"])

    # Merged, not sent to all tasks: labels grow with the documents.
    labelled = (docs.filter(fold(F.col("doc_id")) != held_out).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                .join(told.hint("merge"), "doc_id")
                .select("text", F.col("__y").alias("y")))
    once = keep(labelled.mapInArrow(keyed, "h long, s long, y long, text string").groupBy("h", "s", "y").agg(F.min("text").alias("text")),
                "labelled")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(sent.value)
        for batch in batches:
            n: dict[str, list[int]] = {"": [0, 0]}
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for f in {"", *[f for w in own.words(t.as_py()) for f in features(w)]}:
                    at = n.setdefault(f, [0, 0])
                    at[0] += y
                    at[1] += 1
            yield pa.record_batch({"feature": pa.array(n.keys(), pa.string()), "t": pa.array([x[0] for x in n.values()], pa.int64()),
                                   "n": pa.array([x[1] for x in n.values()], pa.int64())})

    counts = keep(once.select("y", "text").mapInArrow(seen, "feature string, t long, n long").groupBy("feature")
                  .agg(F.sum("t").alias("t"), F.sum("n").alias("n")), "features")
    whole = counts.filter("feature = ''").first()
    if whole is None or whole.n == 0:
        return Model(0.1, {}, log_p)
    base = (whole.t + 0.5) / (whole.n + 1)
    share, rest = F.col("t") / F.col("n"), (F.col("n") - F.col("t")) / F.col("n")
    apart = share * F.log(share / base) + F.when(rest > 0, rest * F.log(rest / (1 - base))).otherwise(0.0)
    evidence = F.log(((F.col("t") + 0.5) / (whole.t + 1.0)) / ((F.col("n") - F.col("t") + 0.5) / (whole.n - whole.t + 1.0)))
    limit = math.log(max(1.0, counts.count() / chance))
    telling = (counts.filter((F.col("feature") != "") & (share >= least_share) & (share > base) & (F.col("n") * apart > limit))
               .select("feature", evidence.alias("e"), "t"))
    if telling.count() > max_features:
        return Model(base, {}, log_p, table=_common(once.filter("y = 1"), telling, log_p))
    rows = telling.collect()
    common = spark.sparkContext.broadcast({r.feature: r.t for r in rows})

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = Restorer(sent.value), set()
        for batch in batches:
            for t in batch.column(0):
                has = {f for w in own.words(t.as_py()) for f in features(w) if f in common.value}
                most = max((common.value[f] for f in has), default=0)
                found |= {f for f in has if 2 * common.value[f] >= most}
        yield pa.record_batch({"feature": pa.array(sorted(found), pa.string())})

    named = {r.feature for r in once.filter("y = 1").select("text").mapInArrow(chosen, "feature string").distinct().collect()}
    return Model(base, {r.feature: r.e for r in rows if r.feature in named}, log_p)


def _common(toxic: DataFrame, telling: DataFrame, log_p: np.ndarray) -> DataFrame:
    """Of the features ``telling`` (feature, e, t) those among the commonest of some toxic text, by joins; see ``fit``."""
    sent = toxic.sparkSession.sparkContext.broadcast(log_p)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(sent.value)
        for batch in batches:
            yield pa.record_batch({"has": pa.array([sorted({f for w in own.words(t.as_py()) for f in features(w)})
                                                    for t in batch.column(0)], pa.list_(pa.string()))})

    texts = keep(toxic.select("text").mapInArrow(listed, "has array<string>").withColumn("id", F.monotonically_increasing_id()), "toxic")
    uses = texts.select("id", F.explode("has").alias("feature")).join(telling, "feature")
    most = uses.groupBy("id").agg(F.max("t").alias("most"))
    named = uses.join(most, "id").filter(2 * F.col("t") >= F.col("most")).select("feature").distinct()
    return keep(telling.select("feature", "e").join(named, "feature", "left_semi"), "evidence")


def _by_table(rest: DataFrame, model: Model, text: str, columns: list[str], name: str, restored: str | None) -> DataFrame:
    """``with_score`` by joins of words with the table of evidence.  Rows are written once with an id and their words."""
    sent = rest.sparkSession.sparkContext.broadcast(model.log_p)
    schema = T.StructType([*[rest.schema[c] for c in columns], T.StructField("__words", T.ArrayType(T.StringType()))]
                          + ([T.StructField(restored, T.StringType())] if restored else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(sent.value)
        for batch in batches:
            told = [t.as_py() for t in batch.column(text)]
            new = [pa.array([sorted(own.words(t)) for t in told], pa.list_(pa.string()))]
            if restored:
                new.append(pa.array([own.restore(t) for t in told], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], schema.names)

    rows = keep(rest.mapInArrow(read, schema).withColumn("__id", F.monotonically_increasing_id()), "words")
    used = rows.select("__id", F.explode("__words").alias("__word"))
    word, size = F.col("__word"), F.length("__word")
    own = F.array_compact(F.array(F.concat(word, F.lit("$")), *[F.when(size >= k, F.substring(word, 1, k)) for k in PREFIXES]))
    known = (used.select("__word").distinct().select("__word", F.explode(own).alias("feature")).join(model.table, "feature")
             .groupBy("__word").agg(F.max("e").alias("e")).filter("e > 0"))
    odds = used.join(known, "__word").groupBy("__id").agg(F.aggregate(
        F.sort_array(F.collect_list("e")), F.lit(0.0), lambda a, e: a + e).alias("__odds"))
    total = F.least(F.greatest(F.lit(model.prior()) + F.coalesce("__odds", F.lit(0.0)), F.lit(-35.0)), F.lit(35.0))
    scored = rows.join(odds, "__id", "left").withColumn(name, 1 / (1 + F.exp(-total)))
    return scored.select(*columns, name, *([restored] if restored else []))


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", restored: str | None = None,
               keep_text: bool = True) -> DataFrame:
    """Adds the score of every whole text, and its restored form under the name ``restored`` if given.

    Null and empty texts get the base rate.  Columns of these names are replaced, all others stay as they are.  The model
    has at most ``max_features`` features and 28**4 cells and is broadcast; one with more is joined with the words.
    """
    bounded_batches(docs.sparkSession)
    added = [n for n in (name, restored) if n]
    rest = docs.select(text, *[c for c in docs.columns if c != text]) if text in added else docs.drop(*added)
    columns = [c for c in rest.columns if (keep_text or c != text) and c not in added]
    if model.table is not None:
        return _by_table(rest, model, text, columns, name, restored)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[rest.schema[c] for c in columns], T.StructField(name, T.DoubleType())]
                          + ([T.StructField(restored, T.StringType())] if restored else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        read = Restorer(own.log_p)
        for batch in batches:
            told = [t.as_py() for t in batch.column(text)]
            new = [pa.array([own.score(read.words(t)) for t in told], pa.float64())]
            if restored:
                new.append(pa.array([read.restore(t) for t in told], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], schema.names)

    return rest.mapInArrow(run, schema)
