"""The blocked similarity join loses no pair; renumbering follows the rules."""

import random
from difflib import SequenceMatcher

import pytest

from proofloom.operators import orders as O
from proofloom.operators import similar
from proofloom.operators.similar import candidate_pairs, longest_short, similar_names
from tests.conftest import rows

WORDS = "data email secure phishing basics for the admin role module one two three cloud privacy".split()


def names(seed):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS[:8], k=r.randint(1, 4))) for _ in range(120)]
    return sorted({*base, *(b.replace(r.choice("aeiou"), r.choice(["", "x", "ee"]), 1) for b in base)} - {""})


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_similar_names_against_all_pairs(spark, threshold):
    left, right = names(1), names(2)
    a = spark.createDataFrame([("o", n) for n in left], "order_id string, key string")
    b = spark.createDataFrame([("o", n) for n in right], "order_id string, key string")
    got = {(r.left_key, r.right_key) for r in similar_names(a, b, ["order_id"], threshold).collect()}
    want = {(x, y) for x in left for y in right if SequenceMatcher(None, x, y).ratio() >= threshold}
    assert got == want and len(want) > 10


def odd_names(seed, n=150):
    r = random.Random(seed)
    base = ["".join(r.choices("ab é0", k=r.randint(1, 9))) for _ in range(n)]
    base += ["".join(r.choices("abcdefghij ", k=r.randint(20, 60))) for _ in range(n // 3)]
    for b in list(base):
        cut = list(b)
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(cut) + 1)
            cut[at:at + r.randint(0, 1)] = r.choice(["", "x", "ab"])
        base.append("".join(cut))
    return sorted({*base, "a" * 300, "a" * 290 + "b"} - {""})


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
def test_no_pair_is_lost(spark, threshold):
    """Short, repetitive and long names: candidates hold every pair that reaches the threshold, and names of any length."""
    left, right = odd_names(1), odd_names(2)
    a, b = (spark.createDataFrame([(n,) for n in x], "name string") for x in (left, right))
    got = {(r.left_key, r.right_key) for r in candidate_pairs(a, b, threshold).collect()}
    assert {(x, y) for x in left for y in right if x != y and SequenceMatcher(None, x, y).ratio() >= threshold} <= got


def test_few_pairs_are_scored(spark):
    """At 0.85 the index leaves a small share of all pairs of names."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 9))) for _ in range(60)]
    names_ = sorted({" ".join(r.choices(words, k=4)) for _ in range(600)})
    a = spark.createDataFrame([(n,) for n in names_], "name string")
    assert candidate_pairs(a, a, 0.85).count() < len(names_) ** 2 / 10


def test_bounds_of_short_names():
    assert longest_short(0.6) is None and longest_short(0.85) < longest_short(0.8) < longest_short(0.7)


def test_renumber_against_brute_force(spark):
    r = random.Random(5)
    pool = names(3)
    items = [(o, f"{1000 + i}{r.choice(['', 'A', 'P'])}", f"{r.choice(pool)} {1000 + i}", r.choice(["add", "remove"]))
             for o in range(4) for i in r.sample(range(400), 60)]
    items += [(9, f"{2000 + i}", f"data basics {2000 + i}", "add" if i % 2 else "remove") for i in range(20)]
    df = spark.createDataFrame(items, "order_id int, number string, name string, action string")
    got = {(x.order_id, x.number): x.replaces for x in O.renumber_candidates(df).collect()}

    def key(name):
        return name.rsplit(" ", 1)[0]

    want = {}
    for o, n, name, action in items:
        best, top = None, 0.0
        for _, m, other, _ in sorted((i for i in items if i[0] == o and i[3] == "remove"), key=lambda i: i[1]):
            if m[:4] != n[:4]:
                ratio = SequenceMatcher(None, key(name), key(other)).ratio()
                if ratio > top:
                    best, top = m, ratio
        if action == "add" and best is not None and top >= 0.85:
            want[(o, n)] = best
    assert got == want and len(want) > 10


def test_variants_never_replace_each_other(spark):
    df = spark.createDataFrame([(1, "1100A", "Same 1100A", "add"), (1, "1100", "Same 1100", "remove")],
                               "order_id int, number string, name string, action string")
    assert O.renumber_candidates(df).count() == 0


def test_compare_demo_and_keep(spark):
    schema = "order_id int, number string, name string, note string, source string, license_count int"
    wanted = spark.createDataFrame([(1, "1001", "A 1001", "NEW", "x", None), (1, "1002", "B 1002", "", "x", None), (1, "2026", "C 2026", "", "x", None)], schema)
    present = spark.createDataFrame([(1, "1001", "A 1001", "", "Portal", 5), (1, "1003", "D", "", "Portal", 5),
                                     (1, "1004", "E", "", "Portal", 9), (1, "1005", "F", "", "Portal", 5)], schema)
    keep = spark.createDataFrame([(1, "1005")], "order_id int, number string")
    got = O.compare_lists(wanted, present, keep)
    assert rows(got, "number", "action", "note") == [
        ("1001", "add", "NEW, demo license (5) on portal"), ("1002", "add", ""), ("1003", "demo_remove", ""),
        ("1004", "remove", ""), ("1005", "reset", ""), ("2026", "review", "")]


@pytest.mark.parametrize("most", [0, 400, 1 << 24])
def test_names_meet_in_their_scopes(spark, most):
    """Looked through, by the index, or some scopes each way: the same pairs, with their ratios."""
    r, pool = random.Random(11), odd_names(3) + names(4)
    left, right = ([(o, n) for o in range(5) for n in r.sample(pool, 8 + 20 * o)] + [(7, "a" * 300), (None, "x"), (8, ""), (9, None)] for _ in range(2))
    a, b = (spark.createDataFrame(x, "order_id int, key string") for x in (left, right))
    got = {(x.order_id, x.left_key, x.right_key): x.ratio for x in similar_names(a, b, ["order_id"], 0.8, most).collect()}
    want = {(o, x, y): 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for o, x in left for p, y in right if o is not None and o == p and x and y}
    want = {k: v for k, v in want.items() if v >= 0.8}
    assert got == pytest.approx(want) and (7, "a" * 300, "a" * 300) in got


def test_names_of_other_scopes_add_nothing(spark, monkeypatch):
    """A name met in one order only is not compared with the names of all orders."""
    def all_names(*_):
        raise AssertionError("names of all scopes were matched")

    monkeypatch.setattr(similar, "candidate_pairs", all_names)
    a = spark.createDataFrame([(o, f"large ring {100000 + o}") for o in range(200)], "order_id int, key string")
    assert similar_names(a, a, ["order_id"], 0.85).count() == 200
