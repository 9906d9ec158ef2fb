import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofloom.functions import text as T
from proofloom.functions import web
from proofloom.operators import nested as N
from proofloom.operators import structure as S
from proofloom.operators.stored import stored
from proofloom.operators.words import segments_to_items, words_to_segments
from tests.conftest import rows


def test_alignment_splits_and_extras(spark):
    std = ["Intro", "Cyber Hygiene at Work", "Passwords", "End"]
    alt = ["zzzz", "Cyber Hygiene", "Cyber Hygiene Work", "qqqq", "Passwords"]
    data = [("c", i, f"s{i}", t, "Standard") for i, t in enumerate(std)]
    data += [("c", 10 + i, f"a{i}", t, "Accessible") for i, t in enumerate(alt)]
    df = spark.createDataFrame(data, "course_id string, ord int, slide_id string, slide_title string, path string")
    assert rows(S.align_paths(df), "slide_id", "standard_slide_id", "kind") == [
        ("a0", None, "only"), ("a1", "s1", "match"), ("a2", "s1", "match"), ("a3", "s1", "extra"), ("a4", "s2", "match")]


@pytest.mark.parametrize("targets,terminal,steps,end", [
    ({"a": ["b"], "b": ["c"], "c": []}, {"c"}, "abc", "terminal"),
    ({"a": ["b"], "b": ["a"]}, set(), "aba", "edges_used"),
    ({"a": ["b", "c"], "b": ["a"], "c": []}, set(), "abac", "no_forward_control"),
    ({"a": ["x"]}, set(), "a", "unknown_screen")])
def test_route(targets, terminal, steps, end):
    frame = pd.DataFrame([("k", i, s, t, s in terminal) for i, (s, t) in enumerate(targets.items())],
                         columns=["course_id", "ord", "slide_id", "targets", "terminal"])
    out = S._route(frame)
    assert "".join(out["slide_id"]) == steps and set(out["end_reason"]) == {end}


@pytest.mark.parametrize("texts,verified,first", [
    (["B. x", "A. y"], True, "A. y"), (["2) x", "1) y", "3) z"], True, "1) y"), (["A. x", "C. y"], False, "A. x"),
    (["A. x", "1. y"], False, "A. x"), (["A. x"], False, "A. x"), (["x", "A. y"], False, "x"), (["A. x", "A. y"], False, "A. x")])
def test_option_order(spark, texts, verified, first):
    q = spark.createDataFrame([("multiplechoice", [(str(i), t) for i, t in enumerate(texts)])], "question_type string, choices array<struct<id:string,text:string>>")
    r = S.option_order(q).first()
    assert (r.verified, r.choices[0].text, r.needs_check) == (verified, first, not verified)


def test_deep_objects_and_conditions(spark):
    deep = '{"id":"o9","kind":"image"}'
    for i in range(8, -1, -1):
        deep = f'{{"id":"o{i}","kind":"group","text":"a ] b","objects":[{deep}]}}'
    payload = f'{{"slideLayers":[{{"id":"b","isBaseLayer":true,"objects":[{deep}]}}]}}'
    df = spark.createDataFrame([("c", "s", payload), ("c", "t", "not json")], "course_id string, slide_id string, payload string")
    v = df.withColumn("v", F.try_parse_json("payload"))
    assert [r.obj_id for r in N.flatten_objects(v, "course_id", "slide_id").orderBy("path").collect()] == [f"o{i}" for i in range(10)]
    assert N.actions(df, "course_id", "slide_id").filter("slide_id = 't'").count() == 0


def test_called_groups_are_followed(spark):
    payload = ('{"slideLayers":[{"id":"b","isBaseLayer":true,"objects":[{"id":"o","kind":"image","accType":"button","events":[{"kind":"onclick",'
               '"actions":[{"kind":"if_action","thenActions":[{"kind":"exe_actiongroup","id":"g1"}]}]}]}]}],'
               '"actionGroups":{"g1":{"actions":[{"kind":"exe_actiongroup","id":"g2"},{"kind":"close_player"}]},'
               '"g2":{"actions":[{"kind":"gotoplay","objRef":{"value":"_player.x.s2"}},{"kind":"exe_actiongroup","id":"g1"}]}}}')
    df = spark.createDataFrame([("c", "s", payload)], "course_id string, slide_id string, payload string")
    e = N.click_effects(N.actions(df, "course_id", "slide_id"), "course_id", "slide_id").first()
    assert (e.obj_id, e.advances_to, e.exits, e.is_media) == ("o", "s2", True, False)


def _jump(to):
    return f'{{"kind":"gotoplay","objRef":{{"value":"_player.x.{to}"}}}}'


@pytest.mark.parametrize("acts,click,alone", [
    # Both branches of a condition, named against the order of the alphabet.
    (f'{{"kind":"if_action","thenActions":[{_jump("s1")}],"elseActions":[{_jump("s2")}]}}', "s2", "s1"),
    # A called group stands at the place of its call.
    (f'{{"kind":"exe_actiongroup","id":"g9"}},{_jump("s3")}', "s3", "end"),
    (f'{_jump("s3")},{{"kind":"exe_actiongroup","id":"g9"}}', "end", "s3"),
    # A chain of ten groups.
    ('{"kind":"exe_actiongroup","id":"g0"}', "end", "end"),
    # Groups that call each other and nothing else.
    ('{"kind":"exe_actiongroup","id":"h0"}', None, None)])
def test_order_of_jumps(spark, acts, click, alone):
    groups = [f'"g{i}":{{"actions":[{{"kind":"exe_actiongroup","id":"g{i + 1}"}}]}}' for i in range(9)]
    groups += [f'"g9":{{"actions":[{_jump("end")}]}}', *(f'"h{i}":{{"actions":[{{"kind":"exe_actiongroup","id":"h{1 - i}"}}]}}' for i in (0, 1))]
    payload = (f'{{"slideLayers":[{{"id":"b","isBaseLayer":true,"objects":[{{"id":"o","kind":"image","accType":"button","events":['
               f'{{"kind":"onclick","actions":[{acts}]}}]}}]}}],"events":[{{"kind":"ontimelinecomplete","actions":[{acts}]}}],'
               f'"actionGroups":{{{",".join(groups)}}}}}')
    df = spark.createDataFrame([("c", "s", payload)], "course_id string, slide_id string, payload string")
    found = N.actions(df, "course_id", "slide_id")
    assert rows(N.click_effects(found, "course_id", "slide_id"), "obj_id", "advances_to") == [("o", click)]
    assert rows(N.passive_effects(df, found, "course_id", "slide_id"), "auto_advance") == [(alone,)]


def test_numbers_of_any_size_sort(spark):
    numbers = [0, 7, 99999, 100000, 123456, 123457, 1000000, 2147483647]
    keys = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n int").coalesce(1).select(N._at(F.col("n"))).collect()]
    assert keys == sorted(set(keys))
    names = ["a 7", "a 10", "a " + "9" * 20, "a 1" + "0" * 20, "a 1234567890123456789012", "a 1234567890123456789013", "a 9" + "0" * 21, "ab"]
    keys = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(T.natural_key(F.col("n"))).collect()]
    assert keys[:-1] == sorted(set(keys[:-1])) and len(set(keys)) == len(keys)


@pytest.mark.parametrize("base,ref,want", [
    ("http://h/a/b?q", "c", "http://h/a/c"), ("http://h/a/b/", "../c/./d", "http://h/a/c/d"), ("http://h", "x", "http://h/x"),
    ("http://h/a", "//o/x", "http://o/x"), ("http://h/a?q", "#f", "http://h/a?q#f"), ("http://h/a", "https://z", "https://z"),
    ("http://h/a/b", "/", "http://h/"), ("http://h/a/b/c", "..", "http://h/a/"), ("http://h/a", "../../x", "http://h/x")])
def test_join_url(spark, base, ref, want):
    assert spark.range(1).select(web.join_url(F.lit(base), F.lit(ref))).first()[0] == want


@pytest.mark.parametrize("text,want", [
    ("the the cat", ["the"]), ("cat dog cat", ["cat"]), ("the dog the", []), ("que que", ["que"]), ("Été été", ["été"]), ("a b c", [])])
def test_doubled_words(spark, text, want):
    hit = T.doubled_words(F.lit(text), F.array(F.lit("the")), F.array().cast("array<string>"))
    assert spark.range(1).select(hit).first()[0] == want


def test_two_columns_of_wrapped_names(spark):
    lines = [(10, "Anti Phishing", "Data"), (20, "Essentials 10101 - NEW", "Safety 10103P"), (30, "Excel 10102", "VA, Fairfax, VA 22033"), (40, "Word 10109", "Pay $ 10105")]
    words = []
    for top, *columns in lines:
        for x, text in zip((50.0, 300.0), columns):
            for w in text.split():
                words.append(("d", 1, w, x, x + 4 * len(w), float(top), float(top + 9)))
                x += 4 * len(w) + 3
    df = spark.createDataFrame(words, "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double")
    got = segments_to_items(words_to_segments(df))
    assert rows(got.filter("kind = 'item'"), "number", "name", "note") == [
        ("10101", "Anti Phishing Essentials 10101", "NEW"), ("10102", "Excel 10102", ""), ("10103P", "Data Safety 10103P", ""), ("10109", "Word 10109", "")]


def test_lines_reach_from_their_first_word_and_places_may_lack(spark):
    """Tops 0, 2, 4: the third word is within reach of the second, not of the first."""
    words = [("d", 1, "one", 0.0, 5.0, 0.0, 9.0), ("d", 1, "two", 7.0, 12.0, 2.0, 11.0), ("d", 1, "three", 14.0, 20.0, 4.0, 13.0),
             ("e", 1, "lost", 0.0, 5.0, None, None)]
    df = spark.createDataFrame(words, "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double")
    got = rows(words_to_segments(df), "doc_id", "line_no", "text")
    assert got == [("d", 0, "one two"), ("d", 1, "three"), ("e", None, "lost")]
    assert words_to_segments(df.limit(0)).count() == 0 and segments_to_items(words_to_segments(df.limit(0))).count() == 0


def test_items_of_one_column(spark):
    lines = ["Alpha Course 20101 (with its", "long lab 9999", "annex) - NEW", "Beta 20102", "UPDATED MODULE", "Gamma", "Delta", "Eps", "Zeta 20103",
             "CL-20104-AB - Eta", "Not read 20105", "$ 5", "Theta (201066)", "2025", "Kappa 20101", "See 20102 above", "Iota 20107: a talk", "Lost 20199 here"]
    segments = [("d", 1, n, 0, 50.0, 12.0 * n, text, 20.0) for n, text in enumerate(lines)]
    segments += [("d", 1, 99, 0, 50.0, 900.0, "Late 20108", 20.0), ("d", 1, 100, None, 700.0, 912.0, "Omega 20109 - UPDATED", 20.0)]
    df = spark.createDataFrame(segments, "doc_id string, page int, line_no int, col int, x0 double, top double, text string, gap_limit double")
    got = rows(segments_to_items(df.repartition(3)), "kind", "number", "name", "note", "reason")
    items = {r[1]: r[2:4] for r in got if r[0] == "item"}
    assert items["20101"] == ("Alpha Course 20101", "NEW") and items["20102"] == ("Beta 20102", "UPDATED MODULE")
    assert items["20103"] == ("Gamma Delta Eps Zeta 20103", "") and items["20104"] == ("Eta 20104", "")
    assert items["20107"] == ("Iota 20107: a talk", "") and items["20108"] == ("Late 20108", "") and items["20109"] == ("Omega 20109", "UPDATED")
    reviews = {(r[2], r[4]) for r in got if r[0] == "review"}
    assert ("Theta (201066)", "mistyped number") in reviews and ("Lost 20199 here", "unread") in reviews
    assert ("Kappa 20101", "same number as another item") in reviews and not any("20102 above" in name for name, _ in reviews)


def test_words_are_exchanged_once(spark):
    """Edges and segments read one exchange of a page's words; pages without a number or document keep their own heights."""
    words = [(d, p, f"w{i}", 50.0 + 200 * (i % 3), 90.0 + 200 * (i % 3), 20.0 * (i // 3), 20.0 * (i // 3) + h)
             for d, p, h in ((1, 1, 9.0), (1, 2, 12.0), (None, 1, 7.0), (None, None, 20.0)) for i in range(9)]
    told = stored(spark.createDataFrame(words, "doc_id int, page int, text string, x0 double, x1 double, top double, bottom double"), "test")
    got = words_to_segments(told)
    found = got.collect()
    limits = {(r.doc_id, r.page): r.gap_limit for r in found}
    assert len(found) == 36 and limits == {(1, 1): pytest.approx(19.8), (1, 2): pytest.approx(26.4), (None, 1): pytest.approx(15.4), (None, None): pytest.approx(44.0)}
    assert {(r.col, r.x0) for r in found} == {(0, 50.0), (1, 250.0), (2, 450.0)}
    # The marks of lines join the words in one place, those of edges in another.
    ran = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("Union") == 2 and "ReusedExchange" in ran


def test_items_send_no_table_of_pages_to_the_driver(spark):
    segments = [(d, 1, n, 0, 50.0, 12.0 * n, t, 20.0) for d in (1, 2) for n, t in enumerate(("Essentials 1001A - NEW", "See 1002Z in the annex"))]
    told = stored(spark.createDataFrame(segments, "doc_id int, page int, line_no int, col int, x0 double, top double, text string, gap_limit double"), "test")
    got = segments_to_items(told)
    assert rows(got, "doc_id", "kind", "number", "note") == [
        (1, "item", "1001A", "NEW"), (1, "review", None, ""), (2, "item", "1001A", "NEW"), (2, "review", None, "")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
