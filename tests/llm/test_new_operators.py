"""Hard negatives, toxicity and tokenizer alignment against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proofloom.llm import alignment, catalog, hard_negatives, integers, ngram_join, packing, quality, tokenfiles, tokens, toxicity, vectors
from proofloom.llm.common import new_path, pieces

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_negatives(rows, positives=5, negatives=10, every=10):
    rows = {(i, tuple(math.floor(256 * float(x)) for x in v), y) for i, v, y in rows
            if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, v, y in rows:
        if a % every:
            continue
        told = [(-sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in rows if i != a and len(w) == len(v)]
        for s, p, _ in sorted(t for t in told if t[2] == y)[:positives]:
            s = -s
            near = sorted(t for t in told if t[2] != y and 30 * s <= -100 * t[0] <= 90 * s)[:negatives]
            out += [(a, p, r, i, s, -t) for r, (t, i, _) in enumerate(near, 1)]
    return Counter(out)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows],
                                 "vec_id long, embedding array<float>, label int, h string, cluster string")


def some_vectors(n=400, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 3 * rng.normal(size=(8, dim))[rng.integers(0, 8, n)]
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    return [(i, x, int(y)) for i, (x, y) in enumerate(zip(v.tolist(), rng.integers(0, 4, n)))]


@pytest.mark.parametrize("anchors,candidates,step", [(4096, 8192, 512), (7, 60, 16)])
def test_hard_negatives(spark, monkeypatch, anchors, candidates, step):
    for name, value in (("ANCHOR_BLOCK", anchors), ("CANDIDATE_BLOCK", candidates), ("STEP", step)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some_vectors()
    # Ties, repeats, an id with two vectors, other lengths, zero vectors and rows that take no part.
    rows += [(500 + i, rows[3][1], 1) for i in range(12)] + [(510, rows[3][1], 1), (510, rows[4][1], 2), (20, rows[20][1], rows[20][2])]
    rows += [(600 + i, [float(i), 1.0], i % 2) for i in range(21)] + [(700, [0.0] * 6, 1), (710, [0.0, 0.0], 0), (720, [], 1), (721, [], 0)]
    rows += [(None, rows[1][1], 1), (730, None, 1), (740, rows[1][1], None), (750, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (760, [float("nan")] * 6, 1)]
    got = hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, clusters=5)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)
    assert hard_negatives.mine(vectors_of(spark, rows[:0]), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(vectors_of(spark, rows[1:9]), F.col("vec_id") % 10 == 0).count() == 0


def test_hard_negatives_beyond_a_double(spark):
    rows = [(i, [x * 2.0 ** 20 for x in v], y) for i, v, y in some_vectors(80)]
    got = hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows)


def test_walks_end_early():
    rng = np.random.default_rng(1)
    towards = rng.normal(size=8)
    members = np.rint(1000 * (towards + 0.05 * rng.normal(size=(20, 8)))).astype(np.int64)
    others = np.rint(1000 * rng.normal(size=(20_000, 8))).astype(np.int64)
    ids = np.arange(20_000)
    best = [[hard_negatives._Best(10)] for _ in members]
    made = hard_negatives.walk(members, np.full(20, -1), best, others, ids, lambda m, places: np.ones(len(places), bool))
    products = members @ others.T
    for m, (b,) in enumerate(best):
        assert b.ids.tolist() == np.lexsort((ids, -products[m]))[:10].tolist()
    assert made < products.size / 4


def test_exact_products():
    for most in (1 << 10, 1 << 29, 1 << 40, 1 << 61):
        r = random.Random(most)
        a, b = ([[r.randint(-most, most) for _ in range(5)] for _ in range(4)] for _ in range(2))
        got = integers.exact_products(np.array(a, np.int64), np.array(b, np.int64))
        assert [[int(x) for x in row] for row in got] == [[sum(p * q for p, q in zip(x, y)) for y in b] for x in a]
    assert integers.clamped(1 << 70) == (1 << 63) - 1 and integers.clamped(-(1 << 70)) == -(1 << 63)


def test_hard_negatives_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = catalog.QUERIES["op11_hard_negatives"](spark, sf)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, every=100)


GOOD = "the water of a river runs down to the sea and there it meets another water which nobody has named before".split()
BAD = "idiot moron worthless clown trash".split()
DISGUISED = {"1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "idiooooot": "idiot", "m0r0n": "moron", "w0rthl3ss": "worthless",
             "c-l-0-w-n": "clown", "tr@$h": "trash", "t r 4 s h": "trash", "cl0wnnnn": "clown"}


def toxic_corpus():
    r = random.Random(4)
    texts = []
    for i in range(600):
        words = r.choices(GOOD, k=r.randint(5, 60))
        if i % 5 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        texts.append((i, " ".join(words), int(i % 5 == 0)))
    return texts


def test_toxicity_plain_words_need_no_pattern(monkeypatch):
    log_p = toxicity.log_probabilities(toxicity.byte_counts(t.encode() for _, t, _ in toxic_corpus()))
    slow = {t: toxicity.Restorer(log_p).token(t) for t in ("idiooot", "sch\u00f6n!!", "$tupid", "a-b", "...")}
    monkeypatch.setattr(toxicity, "EDGE", None)
    own = toxicity.Restorer(log_p)
    assert own.words("(hello), 'W\u00f6rter' good.") == {"hello", "w\u00f6rter", "good"} and own.restore("(Good).") == "(good)."
    monkeypatch.undo()
    assert {t: own.token(t) for t in slow} == slow
    # Words that begin like no feature are not looked up; of the others whole words and beginnings count.
    model = toxicity.Model(0.5, {"idiot$": 2.0, "idi": 1.0, "ab$": 0.5}, log_p)
    assert model.score({"good", "idiom", "ab", "abc"}) == pytest.approx(1 / (1 + math.exp(-1.5)))
    assert model.score({"idiot"}) == pytest.approx(1 / (1 + math.exp(-2.0))) and "good" not in model.known


def test_toxicity_restores_spans_of_any_length():
    """A disguised word is read in a token, and in a spaced-out run, of more than 256 characters, in time that grows with it."""
    log_p = toxicity.log_probabilities(toxicity.byte_counts(t.encode() for _, t, _ in toxic_corpus()))
    own = toxicity.Restorer(log_p)
    parts = "/".join(["1d10t"] * 60)
    assert own.decode("1d10t") == "idiot" and own.words(parts) == {"idiot"} and own.restore(f"({parts})") == "(" + "/".join(["idiot"] * 60) + ")"
    assert "idiot" in own.words("i d i o t " * 40)
    for long in ("a" * 20000, "1d10t" * 4000, "x" + "-" * 20000 + "x", "a " * 10000):
        own.words(long)


def test_toxicity_counts_runs_across_cuts():
    """A text of several cuts counts as one."""
    text = ("abc de " * 700_001).encode()
    want, _ = toxicity._counted(b" " + text + b" ", toxicity.START)
    assert want.sum() == 7 * 700_001 and (toxicity.byte_counts([text]) == want).all()


def test_toxicity_restores_and_scores(spark):
    texts = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t, _ in texts], "doc_id long, text string, score string, h int")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(None, 1), (3, None), (4, 9)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    own = toxicity.Restorer(model.log_p)
    assert {d: own.restore(d) for d in DISGUISED} == DISGUISED
    assert own.restore("Running a book\n\nkeeps  2 of 10 letters.") == "running a book\n\nkeeps  2 of 10 letters."
    assert own.restore(None) is None and own.restore("") == ""
    odd = [(None, "no id", 0), (1000, None, 0), (1001, "", 0), (1002, "river " * 200_000 + "i d 1 o t", 1), (1003, "!" * 300_000, 0),
           (1003, "!" * 300_000, 0), (1004, "i " * 100_000, 0)] + [(2000 + n, f"the water, {d}! of the sea", 1) for n, d in enumerate(DISGUISED)]
    more = spark.createDataFrame([(i, t, "x", 7) for i, t, _ in odd], docs.schema)
    rows = toxicity.with_score(more, model, restored="plain").collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "score", "h", "plain"} and len(rows) == len(odd)
    assert Counter((r.doc_id, int(r.score >= 0.3)) for r in rows) == Counter((i, y) for i, _, y in odd)
    held = toxicity.with_score(docs, model).withColumn("f", quality.fold(F.col("doc_id"))).filter("f = 2").collect()
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held) and len(held) > 100


def test_no_feature_is_left_out(spark):
    texts = toxic_corpus() + [(700, None, 0), (700, "", 1)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in texts], "doc_id long, text string, h string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    whole, few = toxicity.fit(docs, labels), toxicity.fit(docs, labels, max_features=3)
    assert len(whole.evidence) > 3 and {r.feature: r.e for r in few.table.collect()} == whole.evidence
    got, want = ([(r.doc_id, r.text, r.h, r.plain, round(r.score, 12)) for r in toxicity.with_score(docs, m, restored="plain").collect()]
                 for m in (few, whole))
    assert Counter(got) == Counter(want)
    assert toxicity.with_score(docs, few, keep_text=False).columns == toxicity.with_score(docs, whole, keep_text=False).columns


def test_viterbi_against_all_readings():
    log_p = toxicity.log_probabilities(toxicity.byte_counts(t.encode() for _, t, _ in toxic_corpus()))
    own = toxicity.Restorer(log_p)

    def cost(text):
        state, total = 0, 0.0
        for k in [*map(toxicity.kind_of, text), 0]:
            if k or state % toxicity.SYMBOLS:
                code = state * toxicity.SYMBOLS + k
                total, state = total - log_p[code], code % (toxicity.CELLS // toxicity.SYMBOLS)
        return total

    for span in ("1d10t", "tr@$h", "w0rth", "cl0wn", "4 t0"):
        readings = {"": 0.0}
        for i, c in enumerate(span):
            beside = i > 0 and span[i - 1].isalnum() or i + 1 < len(span) and span[i + 1].isalnum()
            options = [(c, 0.0 if c.isalpha() or not (c in toxicity.LEET and beside) else toxicity.SIGN_KEPT)]
            options += [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(c, "")] * (not c.isalpha())
            options += [("", toxicity.SEPARATOR_DROPPED)] * (c in toxicity.SEPARATORS and 0 < i < len(span) - 1)
            readings = {r + x: k + w for r, k in readings.items() for x, w in options}
        assert own.decode(span) == min(readings, key=lambda r: readings[r] + cost(r))


def test_language_model_counts_all_characters(spark):
    texts = ["abc abd", None, "", "Élan, vital!", "ß" * 3, "x" * (1 << 21)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = np.zeros(toxicity.CELLS, np.int64)
    for t in texts:
        if not t:
            continue
        kinds, state = [0], 0
        for c in t.lower() + " ":
            k = toxicity.kind_of(c)
            if k or kinds[-1]:
                kinds.append(k)
        for k in kinds[1:]:
            code = state * toxicity.SYMBOLS + k
            want[code] += 1
            state = code % (toxicity.CELLS // toxicity.SYMBOLS)
    # Texts that share a buffer see the boundary between them but not the state before it; the long one is cut once.
    got = toxicity.language_model(docs)
    assert got.shape == want.shape and np.allclose(np.exp(got).reshape(-1, toxicity.SYMBOLS).sum(axis=1), 1)
    assert np.abs(np.exp(got) - np.exp(toxicity.log_probabilities(want))).max() < 0.2
    empty = toxicity.fit(docs.limit(0).selectExpr("1L as doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.base == 0.1 and not empty.evidence


def plain_alignment(texts):
    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    done, counts = [], Counter()
    for i, t in texts:
        links, told, n_a, n_b = [], [], 0, 0
        if t:
            raw, x, y = (" " + t).encode(), a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xb = [bytes(sign[c] for c in a.id_to_token(k)) for k in x]
            yb = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
            if b"".join(xb) == raw == b"".join(yb):
                n_a, n_b = len(x), len(y)
                xe, ye = np.cumsum([len(k) for k in xb]).tolist(), np.cumsum([len(k) for k in yb]).tolist()
                xs, ys = [0, *xe[:-1]], [0, *ye[:-1]]
                # Cuts are the common ends; all overlaps are found by comparing places.
                j = 0
                for k in range(n_a):
                    while ye[j] <= xs[k]:
                        j += 1
                    m = j
                    while m < n_b and ys[m] < xe[k]:
                        links.append((x[k], y[m]))
                        m += 1
                cuts, p, q = sorted(set(xe) & set(ye)), 0, 0
                for c in cuts:
                    p2, q2 = xe.index(c, p) + 1, ye.index(c, q) + 1
                    told.append(",".join(map(str, x[p:p2])) + "|" + ",".join(map(str, y[q:q2])))
                    p, q = p2, q2
        counts.update(links)
        done.append((i, n_a, n_b, links, told))
    best = {}
    for (_, b_id), n in counts.items():
        best[b_id] = max(best.get(b_id, 0), n)
    return Counter((i, n_a, n_b, len(told), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(";".join(told).encode()).hexdigest() if told else "") for i, n_a, n_b, links, told in done)


ODD = ["one", "  two  blanks ", "tab\tand\nline \n mix", "a <|endoftext|> b <s> </s>", "naïve café — ﬁn ñandú", "日本語 テキスト 🎉🎉", "x▁y", "▁", " ", "\n",
       " nbsp　wide\u0085next", "end \x1c sep", "it's 12,345.67%!", "aaaa " * 300, "a" * 3000, "don't  stop\r\n\r\nnow", "é", "'s", "\t", "word \n"]


def test_alignment(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1, None), (2, ""), (3, ODD[0]), (3, ODD[0])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, pair string, cells int").repartition(3)
    for bundle in (alignment.BUNDLE, 2000):
        assert Counter(map(tuple, alignment.align(docs, BPE, PIECES, bundle=bundle).collect())) == plain_alignment(texts)
    assert alignment.align(docs.limit(0), BPE, PIECES).count() == 0
    assert {r.n_a for r in alignment.align(docs.filter("text is null"), BPE, PIECES).collect()} == {0}


def test_units_do_not_change_tokens():
    """A long text, cut into units, has the tokens of the whole."""
    r = random.Random(9)
    own = alignment.Aligner(BPE, PIECES)
    for _ in range(30):
        text = "".join(r.choice(["word", "Ünder", " ", "  ", "\n", "\t", "12", ".", "'ll", "<|endoftext|>", " ", "\x1f", "世", "\r", "-"])
                       for _ in range(400)) or "x"
        whole = own.align(" " + text)
        assert own.document(text) == whole


def test_gallop():
    r = random.Random(2)
    for _ in range(200):
        ends = sorted(r.sample(range(500), r.randint(1, 60)))
        low, value = r.randint(0, len(ends)), r.randint(0, 500)
        want = next((i for i in range(low, len(ends)) if ends[i] >= value), len(ends))
        assert alignment.gallop(ends, value, low) == want


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 14, 2.0 ** 21, 2.0 ** 23])
def test_top_beyond_a_double(spark, scale):
    """Products of any size: components of 1e6 and more, whose sums need longs or whole numbers beyond."""
    rows = [(i, [x * scale for x in v]) for i, v, _ in some_vectors(150)] + [(200, [0.0] * 6), (210, [0.0] * 6)]
    told = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = Counter()
    for a, v in told:
        if a % 50 == 0:
            near = sorted((-sum(p * q for p, q in zip(v, w)), i) for i, w in told if i != a)[:5]
            want += Counter((a, r, i, max(-2 ** 63, min(2 ** 63 - 1, -s))) for r, (s, i) in enumerate(near, 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert Counter(map(tuple, vectors.top_by_segments(df, F.col("vec_id") % 50 == 0).collect())) == want


@pytest.mark.parametrize("blank", ["\u00a0", "\u3000", "\u0085", "\x1c", "\u2028"])
def test_long_texts_are_cut_at_word_ends_only(blank):
    """Three million characters whose borders fall on signs that look blank but end no word."""
    text = f"one{blank}two three\t" * 300_000
    for size in (1 << 20, 1000, 1003, 1004, 1005, 1006):
        assert [w for p in pieces(text, size) for w in p.encode().lower().split()] == text.encode().lower().split()
    assert "".join(pieces(text)) == text and list(pieces("x" * 3000, 1000)) == ["x" * 3000]


def test_long_text_in_the_join(spark):
    text = "one\u00a0two three " * 120_000
    docs = spark.createDataFrame([(1, text), (2, text + "end"), (3, "one")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs, 3, 90).collect()}
    assert got[1][0] == 2 and got[3] == (1, 3)


def test_special_tokens_are_read_as_the_library_reads_them(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z\n<|endoftext|> ", "plain words only"]
    plain = Tokenizer.from_file(BPE)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(tokens.encoder(BPE).encode(t), "<u4").tolist() for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = new_path(spark, "tokens")
    read = tokenfiles.read_tokens(tokenfiles.write_tokens(docs, folder, BPE), folder).collect()
    assert {r.doc_id: r.n_tokens for r in read} == {i: len(w) + 1 for i, w in enumerate(want)}
    assert {r.doc_id: r.doc_tokens for r in packing.pack(docs, BPE).collect()} == {i: len(w) + 1 for i, w in enumerate(want)}
