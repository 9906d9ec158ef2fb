"""Cleaning and removal of links against their plain formulas, and sums read on the plans."""

import itertools
import re

from pyspark.sql import functions as F

from proofloom.catalog import reading as RD
from proofloom.functions import orders as OF
from proofloom.functions import text as T
from proofloom.operators import text_checks as C

PIECES = ["a", " ", "\n", "\r\n", "\t", " ", "​", " ", "\x1c", "b.c"]
LINKS = ["see x", " a.b@c.de ", "HTTP://x.y ", " wWw.z", "//q", "%v%", "p_player.k", "é—ß", " - "]


def texts(pieces, n):
    return ["".join(p) for k in range(n + 1) for p in itertools.product(pieces, repeat=k)] + [None]


def told(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "t string").repartition(4)
    return df.select("t", *columns).collect()


def test_cleaning_equals_the_formula_by_lines(spark):
    c = F.col("t")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[​﻿]", ""), r"(?U)[\s ]+", " "))
    by_lines = F.array_join(F.transform(T.lines(c), plain), "\n")
    for r in told(spark, texts(PIECES, 4), T.clean_text(c).alias("a"), plain(c).alias("b"), T.clean_lines(c).alias("d"), by_lines.alias("e")):
        assert (r.a, r.d) == (r.b, r.e), repr(r.t)


def test_links_go_as_by_the_bare_patterns(spark):
    def by(steps):
        def out(x):
            for pattern in steps:
                x = F.regexp_replace(x, pattern, " ")
            return x
        return out
    removed = by([rf"(?i)\s?(?:{T.EMAIL})\s?", rf"(?i)\s?(?:{T.URL})\s?", r"\s?//\S+\s?", r"\s?\S*_player\.\S*\s?"])
    blanked = by([f"(?i){T.EMAIL}", f"(?i){T.URL}", r"//\S+", r"(?U)%\w+%", r"\S*_player\.\S*"])
    c = F.col("t")
    for r in told(spark, texts(LINKS, 3), T.remove_urls_emails(c).alias("a"), removed(c).alias("b"),
                  T.blank_urls_emails(c).alias("d"), blanked(c).alias("e")):
        assert (r.a, r.d) == (r.b, r.e), repr(r.t)


def test_snippets_of_every_match(spark):
    r = told(spark, ["one,two — three - four;five", "plain", None], T.missing_space_after_punct(F.col("t")).alias("m"),
             T.spaced_em_dashes(F.col("t")).alias("e"), T.hyphens_as_dash(F.col("t")).alias("h"))
    found = {x.t: (x.m, x.e, x.h) for x in r}
    assert found["one,two — three - four;five"] == (["one,two — three - fo", " — three - four;five"], ["one,two — three - four;five"], ["one,two — three - four;five"])
    assert found["plain"] == ([], [], []) and found[None] == (None, None, None)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_removed_and_terms_read_once(spark):
    df = spark.createDataFrame([("a", "b")], "t string, u string")
    assert len(re.findall(r"_player", plan(df.select(C.spacing_array(F.col("t")))))) <= 4
    assert plan(df.select(OF.expiration_dates(F.col("t")))).count("Renewal") <= 4


def test_boxes_add_up_lengths_once(spark, tmp_path):
    lines = ["one word and  another", "", "x", "é long " * 300]
    spark.createDataFrame([(1, "en", "s", "\n".join(lines)), (2, "en", "s", None)], "doc_id long, lang string, source string, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    want = []
    for ord_, line in enumerate(lines):
        words = line.split()
        half = -(-len(words) // 2)
        for part, left in ((words[:half], 50), (words[half:], 2_000_000)):
            for i, w in enumerate(part):
                x = left + sum(len(v) * 5 + 4 for v in part[:i])
                want.append((1, 1, w, float(x), float(x + len(w) * 5), ord_ * 12 + i % 3 * 0.5, ord_ * 12 + i % 3 * 0.5 + 9))
    boxes = RD.boxes(spark, str(tmp_path))
    assert sorted(map(tuple, boxes.collect())) == sorted(want)
    # No sum over the words before inside the walk over words.
    assert "aggregate(slice(slice(" not in plan(boxes)
