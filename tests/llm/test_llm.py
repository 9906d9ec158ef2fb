"""Every operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import catalog, chat, mixing, ngram_join, packing, quality, suffixes, tokenfiles, tokens, urls, vectors
from proofloom.llm.common import new_path
from proofloom.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, size string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[n], len(t or ""), "x", "y") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


BASE = sentence(1, 300)
EDGY = [(0, BASE), (1, None), (2, ""), (3, " \n "), (4, BASE), (5, BASE.replace("w", "W", 40)), (6, BASE + " end"),
        (7, "one two"), (8, "one  two"), (9, "é" * 400 + " " + BASE), (9, "é" * 400 + " " + BASE), (None, "no id here"),
        (10, sentence(2, 300)), (11, "aaaa " * 2000), (12, sentence(2, 150) + " " + sentence(3, 150)), (13, "single")]


def brute_groups(texts, k, num):
    def words(t):
        return (t or "").encode().lower().split()

    sets = [frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if (w := words(t)) else frozenset() for _, t in texts]
    ids = [i for i, _ in texts]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (ids[a], ids[b]) and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets))


@pytest.mark.parametrize("k,num,chunk", [(3, 90, 1 << 19), (5, 80, 1 << 19), (3, 90, 300), (5, 80, 300)])
def test_ngram_join(spark, monkeypatch, k, num, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    near = [(100 + i, " ".join(w for j, w in enumerate(sentence(9, 200).split()) if j != 7 * i)) for i in range(12)]
    texts = EDGY + near
    got = Counter(map(tuple, ngram_join.similar_groups(docs_of(spark, texts), k, num).collect()))
    assert got == brute_groups(texts, k, num)


@pytest.mark.parametrize("k,num,chunk", [(3, 90, 1 << 19), (5, 80, 1 << 19), (3, 90, 300), (5, 80, 300)])
def test_ngram_join_counts_all_links(spark, monkeypatch, k, num, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    # A chain of windows over one text, a clique of near copies, copies of one of them, and an id with two texts.
    chain = [(300 + i, " ".join(sentence(9, 300).split()[6 * i:6 * i + 150])) for i in range(10)]
    near = [(100 + i, " ".join(w for j, w in enumerate(sentence(11, 200).split()) if j != 7 * i)) for i in range(12)]
    texts = EDGY + chain + near + [(200 + i, near[0][1]) for i in range(3)] + [(100, near[5][1] + " x"), (100, near[5][1] + " x")]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    own = {(i, s) for i, t in texts if i is not None and (s := shingles(t))}

    def linked(s, o):
        return 100 * len(s & o) >= num * len(s | o)

    links = {(i, s): sum(linked(s, o) for _, o in own) - 1 for i, s in own}
    want = Counter((i, len(s := shingles(t)), links.get((i, s), 0)) for i, t in texts)
    docs = docs_of(spark, texts)
    got = ngram_join.linked_groups(docs, k, num)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "n_links").collect())) == want
    assert Counter(map(tuple, got.drop("n_links").collect())) == brute_groups(texts, k, num)
    pairs, members = ngram_join.linked_sets(docs, k, num)
    pairs, sets = [tuple(r) for r in pairs.collect()], {s for _, s in own}
    assert len(pairs) == len(set(pairs)) == sum(linked(s, o) for s in sets for o in sets if s != o) // 2
    assert members.count() == len(own)


def test_ngram_join_states_keys_once_a_task(spark):
    text = sentence(9, 200)
    docs = spark.createDataFrame([(None, text), (7, text), (8, text), (9, text), (3, sentence(11, 200))], "doc_id long, text string").coalesce(1)
    rows = ngram_join._features(docs, 3, ngram_join.Threshold(90, 100), "doc_id", "text").collect()
    assert [r.doc_id for r in rows if r["keys"]] == [r.doc_id for r in rows if r["upper_keys"]] == [7, 3]
    assert {r.n for r in rows} == {198}


def test_ngram_join_exchanges_marked_texts_only(spark):
    docs = spark.range(-5000, 20000).selectExpr("nullif(id, 0) as doc_id", "'t' as text")
    ids = spark.range(-5000, 20000, 7).withColumnRenamed("id", "doc_id")
    want = {r.doc_id for r in ids.collect()}
    got = [r.doc_id for r in ngram_join._marked(docs, ids).collect()]
    assert len(got) == len(set(got)) and want - {0} <= set(got) and len(got) < len(want) + 500


def test_ngram_join_empty_and_one_of_each(spark):
    assert ngram_join.similar_groups(docs_of(spark, [])).count() == 0
    kept = ngram_join.one_of_each(docs_of(spark, EDGY))
    assert sorted(kept.columns) == sorted(docs_of(spark, []).columns)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 7, 10, 11, 12, 13]
    assert kept.filter("doc_id is null").count() == 1


def test_one_of_each_judges_by_text(spark):
    # Id 5 has a near copy of 1 and a text of its own; id 6 two texts of its own; id 7 a blank text and one of its own.
    other = [sentence(400 + i, 80) for i in range(5)]
    texts = [(1, BASE), (5, other[0]), (5, BASE + " end"), (6, other[1]), (6, other[2]), (7, " "), (7, other[3]), (8, other[4]), (8, other[4])]
    want = sorted([(1, BASE), (5, other[0]), (6, other[1]), (6, other[2]), (7, " "), (7, other[3]), (8, other[4])])
    assert sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(docs_of(spark, texts)).collect()) == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (100, 95)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(edges.limit(0)).count() == 0


def brute_repeats(texts, least):
    seen, out = set(), {}
    for i, t in sorted({(-1 if i is None else i, (t or "").encode()) for i, t in texts}):
        cover = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if t[p:p + least] in seen:
                cover[p:p + least] = b"\1" * least
            seen.add(t[p:p + least])
        runs = [x for x in bytes(cover).split(b"\0") if x]
        kept = bytes(x for x, c in zip(t, cover) if not c)
        out[None if i < 0 else i] = (len(t), sum(cover), len(runs), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part", [4096, 3])
def test_suffix_dedup(spark, monkeypatch, part):
    monkeypatch.setattr(suffixes, "PART", part)
    passage = sentence(20, 40)
    texts = EDGY + [(200 + i, sentence(50 + i, 30) + passage[i % 3:] + sentence(90 + i, 30)) for i in range(9)]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removed_bytes(docs_of(spark, texts)).collect()}
    assert got == brute_repeats(texts, 100)
    cut = {r.doc_id: r.text for r in suffixes.without_repeats(docs_of(spark, texts)).collect()}
    assert cut[4] == "" and cut[1] is None and cut[0] == BASE and "é" in cut[9]
    assert suffixes.removed_bytes(docs_of(spark, [])).count() == 0


def test_anchors_of_short_texts_together(monkeypatch):
    texts = [sentence(i, 20 + i % 30).encode() for i in range(40)] + [b"ab" * 60, b"a" * 100, b"a" * 3000, bytes(range(1, 120))]
    texts = [t for t in texts if len(t) >= 100]
    for together in (1, 1000, 1 << 16):
        monkeypatch.setattr(suffixes, "TOGETHER", together)
        who, at, hashes = suffixes._anchors_of(texts, 100)
        for i, t in enumerate(texts):
            place, own = suffixes.anchors(t, 100)
            assert (at[who == i] == place).all() and (hashes[who == i] == own).all() and len(place) == (who == i).sum()
    assert [len(x) for x in suffixes._anchors_of([], 100)] == [0, 0, 0]


def test_mixing(spark):
    texts = [(i, sentence(i, 50 + i)) for i in range(60)] + [(90, None), (91, "")]
    sources = [None if i % 7 == 0 else f"s{i % 5}" for i in range(60)] + ["empty", "empty"]
    plan = mixing.plan_mix(docs_of(spark, texts, sources)).collect()
    targets = {r.source: (r.target, r.source_size) for r in plan}
    total = sum(len((t or "").split()) for _, t in texts)
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6
    assert all(t <= 2 * s + 1e-9 for t, s in targets.values()) and targets["empty"] == (0.0, 0)
    assert all(r.copies in (0, 1, 2) for r in plan)
    again = mixing.plan_mix(docs_of(spark, texts, sources).repartition(3))
    assert {(r.doc_id, r.copies) for r in again.collect()} == {(r.doc_id, r.copies) for r in plan}
    assert mixing.emit_mix(again).count() == sum(r.copies for r in plan)
    assert mixing.plan_mix(docs_of(spark, [])).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, mask string"
    rows = [(1, 0, "system", "be kind", "z"), (1, 1, "ann", "hi <|im_end|>", "z"), (1, 2, "bob", None, "z"), (1, 2, "bob", None, "z"),
            (2, None, None, "x", "z"), (3, 0, "system", "alone", "z"), (None, 1, "ann", "lost", "z"), (4, 0, "ann", "a", "z"), (4, 300, "bob", "b", "z")]
    got = {(r.conv_id, r.participant, r.part): r for r in chat.rotate(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", -1), (None, "ann", 0), *((4, p, b) for p in ("ann", "bob") for b in (0, 1))}
    r = got[1, "ann", 0]
    assert r.n_turns == 4 and r.rendered.count("user name=bob") == 2 and [r.rendered[a:b] for a, b in r.mask] == ["hi <| im_end|><|im_end|>"]
    assert got[4, "bob", 1].char_start == len(got[4, "bob", 0].rendered)
    assert chat.rotate(spark.createDataFrame([], schema)).count() == 0


def test_chat_cuts_large_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 2000)
    monkeypatch.setattr(chat, "TURN", 100)
    rows = [(None, None, f"p{i % 3}", f"say {i % 50} " + "x" * (i % 7)) for i in range(200)] + [(1, 5, "ann", "again")] * 150
    rows += [(1, 5, "bob", "é" * 9000), (1, 5, "bob", "é" * 9000), (1, 6, "system", "y" * 4500), (1, 700, "bob", "end"), (2, 0, "ann", "hi"), (2, 1, "bob", None)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert max(len(r.rendered) for r in got) < 2 * 2000 + 200 and max(r.n_turns for r in got) <= 20
    people = {(c, r) for c, _, r, _ in rows if r != "system"}
    assert {(r.conv_id, r.participant) for r in got} == people
    for conv, who in people:
        own = sorted((r for r in got if (r.conv_id, r.participant) == (conv, who)), key=lambda r: r.char_start)
        text, mask = "", set()
        for _, role, says in sorted((-1 if t is None else t, r, x or "") for c, t, r, x in rows if c == conv):
            text += f"<|im_start|>{'assistant' if role == who else role if role == 'system' else 'user name=' + role}\n"
            mask |= set(range(len(text), len(text) + len(says) + len("<|im_end|>"))) if role == who else set()
            text += says + "<|im_end|>\n"
        assert "".join(r.rendered for r in own) == text and sum(r.n_turns for r in own) == sum(c == conv for c, *_ in rows)
        assert [r.char_start for r in own] == [sum(len(x.rendered) for x in own[:n]) for n in range(len(own))]
        assert [r.part for r in own] == sorted(r.part for r in own)
        assert {r.char_start + x for r in own for a, b in r.mask for x in range(a, b)} == mask


@pytest.mark.parametrize("limit,block", [(64 << 20, 1 << 18), (40, 8)])
def test_urls(spark, monkeypatch, limit, block):
    monkeypatch.setattr(urls, "SLICE_BYTES", limit)
    monkeypatch.setattr(urls, "BLOCK", block)
    rng = np.random.default_rng(4)
    hosts = ["a.net", "net", "example.net", "x.example.com", "b.org", "knet"]
    pages = [(i, f"http://{hosts[rng.integers(6)]}/{['en', 'de', 'fr'][rng.integers(3)]}/{i}", "r") for i in range(300)]
    pages += [(900, None, "r"), (901, "no scheme", "r"), (902, "x://A.NET?q/", "r"), (903, "x://a.net/p?q", "r"), (903, "x://a.net/p?q", "r")]
    rules = [*catalog.URL_RULES, *[(f"h{i}.net", "/", "allow") for i in range(50)], (None, "/", "block"), ("net", None, "allow")]
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, rule string"),
                          spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == 305
    for r in got:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = rest.replace("?", "/").split("/")[0].lower()
        path = rest[len(host):].split("?")[0]
        fit = [(len(h + (p or "")), h + (p or ""), v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fit, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty, spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_quality(spark):
    texts = [(i, sentence(i, 40) if i % 4 else " ".join(f"w{i}x{j} ###" for j in range(40))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(None, 1), (3, 7)], "doc_id long, quality int")
    docs = docs_of(spark, texts + [(500, None), (501, "")])
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.with_score(docs, model, keep_text=False).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.7) == (i % 4 > 0) for i in held) >= 0.98 * len(held) and got[500] == got[501]
    same = quality.fit(docs.repartition(5), labels)
    assert np.array_equal(same.weights, model.weights)
    assert quality.fit(docs, labels.limit(0)).bias == 0.0


def brute_top(rows, every, k, product, skip_zero):
    use = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
                  and (not skip_zero or any(v))})
    out = {}
    for i, v in use:
        if i % every == 0:
            best = sorted((-product(v, w), j) for j, w in use if j != i and len(w) == len(v))[:k]
            out[i] = [j for _, j in best]
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(vectors, "SUB_BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300, None), (301, [0.0] * 12), (302, [None] * 12), (303, [float("nan")] * 12),
                                                        (None, rows[1][1]), (3, rows[3][1]), (304, [1.0, 2.0]), (305, [float("inf")] * 12)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")

    def collected(found):
        out = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            out.setdefault(r.query_id, []).append(r.vec_id)
        return out

    near = collected(vectors.nearest_by_tiles(df, F.col("vec_id") % 20 == 0, 20))
    want = brute_top(rows, 20, 20, lambda v, w: float(sum(a * b for a, b in zip(v, w))), True)
    assert near == {i: w for i, w in want.items() if w}
    scaled = [(i, v if v is None else [x if x is None or not np.isfinite(x) else int(np.floor(256 * x)) for x in v]) for i, v in rows]
    top = collected(vectors.top_by_segments(df, F.col("vec_id") % 50 == 0, 5))
    assert top == {i: w for i, w in brute_top(scaled, 50, 5, lambda v, w: sum(a * b for a, b in zip(v, w)), False).items() if w}
    assert vectors.nearest_by_tiles(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def expected_ids(texts, end):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(catalog.vocabulary())
    return [(i, np.array([*own.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in
            sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]


ODD = EDGY + [(20, "  two  blanks "), (21, "a\tb \n\n c d"), (22, "it's, it's. <|endoftext|> x"), (23, "日本語 と 語"), (24, sentence(8, 9000))]


def test_encoder():
    own = tokens.encoder(catalog.vocabulary())
    for (_, ids), (_, t) in zip(expected_ids(ODD, 0), sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        assert own.encode(t or "") == ids[:-1].tobytes()


def test_token_files(spark):
    folder = new_path(spark, "test-tokens")
    files = tokenfiles.write_tokens(docs_of(spark, ODD), folder, catalog.vocabulary(), row=16, files=3)
    got = sorted(map(tuple, tokenfiles.read_tokens(files, folder).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, ids in expected_ids(ODD, 0):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    first = files.orderBy("part").first()
    ids, mask = tokenfiles.TokenFile(folder, first.file).sequence(0)
    assert ids.dtype == np.uint16 and len(ids) == 16 and sum(mask.to_pylist()) == min(16, first.n_tokens)
    assert tokenfiles.write_tokens(docs_of(spark, []), folder + "e", catalog.vocabulary()).count() == 0


@pytest.mark.parametrize("width,buffer", [(2048, 1 << 18), (64, 512)])
def test_packing(spark, monkeypatch, width, buffer):
    monkeypatch.setattr(packing, "BUFFER", buffer)
    rows = packing.pack(docs_of(spark, ODD), catalog.vocabulary(), width=width, partitions=2).collect()
    want = Counter((i, len(x)) for i, x in expected_ids(ODD, 1))
    assert sum(r.length for r in rows) == sum(n * c for (_, n), c in want.items())
    assert {(r.doc_id, r.doc_tokens) for r in rows} == set(want)
    by = {i: x for i, x in expected_ids(ODD, 1)}
    assert all(zlib.crc32(by[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= width
    assert packing.pack(docs_of(spark, []), catalog.vocabulary()).count() == 0


def test_best_cuts():
    rng = np.random.default_rng(6)
    for _ in range(20):
        places = np.r_[0, np.cumsum(rng.integers(1, 9, 14))]
        pens = rng.integers(0, 9, 15)
        cost = {0: 0}
        for j in range(1, 15):
            cost[j] = min(cost[i] + 10 - (places[j] - places[i]) + pens[j] for i in range(j) if places[j] - places[i] <= 10)
        ends = packing.best_cuts(places, pens, 10)
        total = sum(10 - (places[b] - places[a]) + pens[b] for a, b in zip([0, *ends], ends))
        assert total == cost[14]


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = docs_of(spark, [(i, sentence(i, 80)) for i in range(30)] + EDGY).drop("node", "size")
    clean = corpus_pipeline.distinct_documents(spark, docs, "")
    cut = corpus_pipeline.without_repeats(spark, clean, "")
    mix = corpus_pipeline.mixed_sources(spark, cut, "")
    assert clean.columns == cut.columns == mix.columns == docs.columns
    pieces = corpus_pipeline.packed(spark, mix, "")
    assert pieces.select(F.sum("length")).first()[0] == sum(len(x) for _, x in expected_ids([(r.doc_id, r.text) for r in mix.collect()], 1))


def test_pipeline_mix_keeps_columns(spark):
    import corpus_pipeline
    names = ["size", "source_size", "target", "copies", "copy_no"]
    docs = docs_of(spark, [(i, sentence(i, 80)) for i in range(20)]).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    mix = corpus_pipeline.mixed_sources(spark, docs, "")
    assert mix.schema == docs.schema and mix.count() >= 20
    assert all(r[c] == f"{c}{r.doc_id}" for r in mix.collect() for c in names)
