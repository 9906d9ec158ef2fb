"""The classifier against a plain trainer, and the whole pipeline against its five stages in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from proofloom.llm import catalog, quality
from proofloom.llm.common import new_path

from .test_llm import brute_groups, brute_repeats, expected_ids, sentence

MASK = (1 << 64) - 1
MIX, SAME = int(quality.MIX), int(quality.SAME)


def plain_slots(text, bits):
    """Words, pairs of neighbours, and a mark for each token met again at once or over one other."""
    h = [xxhash.xxh3_64_intdigest(t) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    pairs = [(SAME if a == b else (a * MIX & MASK) ^ (b + SAME & MASK)) * MIX & MASK for a, b in zip(h, h[1:])]
    again = [SAME for a, b in zip(h, h[2:]) if a == b]
    return [x >> (64 - bits) for x in h + pairs + again]


def plain_fit(rows, bits=18, scale=20.0, epochs=4, alpha=0.3, beta=1.0, l1=0.02, l2=0.5):
    """FTRL-proximal one coordinate at a time over (text, label) in the given order; weights by slot, None the bias."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for text, label in rows:
            slots = plain_slots(text, bits)
            x = {i: c * scale / len(slots) for i, c in Counter(slots).items()} | {None: 1.0}
            w = {i: weight(i) for i in x}
            error = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - label
            for i in x:
                g = error * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def plain_score(weights, text, bits=18, scale=20.0):
    slots = plain_slots(text, bits)
    dot = sum(weights.get(i, 0.0) for i in slots) * scale / max(1, len(slots)) + weights.get(None, 0.0)
    return 1 / (1 + math.exp(-dot))


def training_rows(spark, texts, labels):
    """Labelled texts outside the held-out fold, in the trainer's order."""
    told = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    hashed = {r.i: r.h for r in spark.createDataFrame([(i,) for i in told], "i long").selectExpr("i", "xxhash64(i) h").collect()}
    return [(t, told[i]) for i, t in sorted((x for x in texts if x[0] in told), key=lambda x: (hashed[x[0]], x[0]))]


def corpus():
    """Clean and noisy documents, near copies, exact copies, shared passages, empty and null texts, five sources."""
    passage = sentence(900, 60)
    texts = [(i, sentence(i, 90)) for i in range(60)]
    texts += [(100 + i, " ".join(f"w{i}x{j} ###" for j in range(50))) for i in range(40)]
    texts += [(200 + i, sentence(i, 90) + " tail") for i in range(6)] + [(210 + i, sentence(3, 90)) for i in range(4)]
    texts += [(220 + i, f"{sentence(300 + i, 70)} {passage} {sentence(400 + i, 70)}") for i in range(8)]
    texts += [(240, None), (241, ""), (242, "x" * 3000), (243, sentence(500, 6000))]
    labels = [(i, int(not 100 <= i < 200)) for i, _ in texts if i < 240]
    return texts, labels


def source_of(i):
    return None if i % 11 == 0 else f"s{i % 4}"


def plain_copies(docs):
    """Copies by id: water-filled targets by source, the rate's floor, and one more by the id's hash."""
    size = {i: len((t or "").split()) for i, t in docs}
    per = Counter()
    for i in size:
        per[source_of(i)] += size[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    left, open_, target = 1.5 * sum(per.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * per[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * per[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    copies = {}
    for i in size:
        rate = target[source_of(i)] / per[source_of(i)] if per[source_of(i)] else 0.0
        chance = int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) / 16 ** 13
        copies[i] = math.floor(rate) + (chance < rate - math.floor(rate))
    return copies


def test_trainer_and_score_against_plain_ones(spark):
    texts, labels = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    plain = plain_fit(training_rows(spark, texts, labels))
    want = np.zeros(1 << 18)
    for i, w in plain.items():
        if i is not None:
            want[i] = w
    assert np.allclose(model.weights, want, atol=1e-5) and abs(model.bias - plain[None]) < 1e-6
    got = {r.doc_id: r.score for r in quality.with_score(docs, model, keep_text=False).collect()}
    assert all(abs(got[i] - plain_score(plain, t)) < 1e-5 for i, t in texts)


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline
    texts, labels = corpus()
    folder = new_path(spark, "test-pipeline")
    rows = [(i, t, "en", source_of(i), len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pieces = corpus_pipeline.run(spark, folder).collect()

    weights = plain_fit(training_rows(spark, texts, labels))
    good = [(i, t) for i, t in texts if plain_score(weights, t) >= corpus_pipeline.QUALITY]
    assert {i for i, _ in good} >= set(range(60)) and not any(100 <= i < 200 for i, _ in good)
    groups = {i: group for i, _, group in brute_groups(good, 5, 80)}
    distinct = [(i, t) for i, t in good if groups[i] == i]
    assert not any(200 <= i < 220 for i, _ in distinct)
    kept = plain_kept(distinct)
    assert any(len(kept[i] or "") < len(t or "") for i, t in distinct)
    copies = plain_copies([(i, kept[i]) for i, _ in distinct])
    ids = dict(expected_ids([(i, kept[i]) for i, _ in distinct], 1))

    # Each id of each copy lies in exactly one piece, pieces hold the ids they state, sequences have no gaps.
    covered = {i: np.zeros(len(ids[i]), int) for i in ids}
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id]) and len(part) == p.length
        covered[p.doc_id][p.start:p.start + p.length] += 1
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert all((covered[i] == copies[i]).all() for i in ids) and max(ends.values()) <= 2048


def plain_kept(texts):
    """Texts without the bytes of 100-byte strings that start earlier; the check of the removed bytes is `brute_repeats`."""
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in texts):
        cover = bytearray(len(t))
        for p in range(len(t) - 99):
            if t[p:p + 100] in seen:
                cover[p:p + 100] = b"\1" * 100
            seen.add(t[p:p + 100])
        out[i] = bytes(x for x, c in zip(t, cover) if not c).decode()
    told = brute_repeats(texts, 100)
    assert all(hashlib.sha256(k.encode()).hexdigest() == told[i][3] for i, k in out.items())
    return out
