"""The package report on one small course per case: each check fires where it should and only there."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofloom.plans import package_report
from proofloom.plans.package_report import Vocabulary, run_all_checks, screen_pass, screen_runs, screen_texts

TEXTS = {
    "s1": ["Pick the the right answer, then go on", "This long paragraph is said on two screens of the course"],
    "s2": ["This long paragraph is said on two screens of the course", "An e-Mail is an Email ,not a qzxv or an ABC"],
    "s3": ["Choose one of these", "mis-quoted well-known", "Use NASA and the ABC list"],
    "s4": ["Press the Tab key to move to an answer", "un mot the answer of course"],
}


@pytest.fixture()
def course(spark):
    rows = spark.createDataFrame([("c", s, i, "fr", v) for s, vs in TEXTS.items() for i, v in enumerate(vs)],
                                 "course_id string, slide_id string, ord int, lang string, value string")
    screens = spark.createDataFrame(
        [("c", i, 1 if i < 3 else 2, f"sc{1 if i < 3 else 2}", "" if i < 3 else "Accessible path", i, f"s{i}", f"Title {i}", i < 3, 60000, "none", "", 0)
         for i in (1, 2, 3, 4)],
        "course_id string, ord int, scene_number int, scene_id string, scene_title string, slide_number int, slide_id string, slide_title string, "
        "is_in_menu boolean, duration_ms long, prev_nav_kind string, prev_nav_target string, history_prev_buttons int")
    objects = spark.createDataFrame([], "course_id string, slide_id string, layer_id string, is_base boolean, ord int, obj_id string, acc_type string, "
                                    "tab_index int, tab_enabled boolean, reference_name string, text string, alt_text string, has_click_event boolean, x_pos double, y_pos double")
    questions = spark.createDataFrame([("c", s, 1, f"q{s}", "Which?", "multiplechoice", False, [("1", "A. x"), ("2", "B. y")]) for s in ("s1", "s3", "s4")],
                                      "course_id string, slide_id string, ord int, question_id string, question_text string, question_type string, is_survey boolean, "
                                      "choices array<struct<id:string,text:string>>")
    packages = spark.createDataFrame([], "course_id string, driver_js string, scoring_configs array<variant>, quiz_configs array<variant>, speed_control boolean, flags array<string>")
    overrides = spark.createDataFrame([], "course_id string, speed_control boolean")
    menu = spark.createDataFrame([("c", "s1", "Title 1"), ("c", "s2", "Another"), ("c", "gone", "Folder")], "course_id string, slide_id string, display string")
    known = {w for vs in TEXTS.values() for v in vs for w in v.lower().replace(",", " ").replace("-", " ").split()} - {"qzxv", "mot", "un", "abc", "nasa", "mis"}
    lexicon = spark.createDataFrame([("en", w) for w in sorted(known)] + [("fr", "un"), ("fr", "mot"), ("fr", "course")], "lang string, word string")
    one = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    words = Vocabulary(lexicon, always_spaced=one("LIST"), never_spaced=one("NASA"), ignored=one("mot"), terms={"email": ["Email", "e-Mail"]})
    return dict(packages=packages, overrides=overrides, screens=screens, rows=rows, objects=objects, questions=questions, menu=menu, vocabulary=words)


def found(course, **how):
    return Counter((r.check_id, r.slide_id, r.message) for r in run_all_checks(**{**course, **how}).collect())


def test_english_course(course):
    got = found(course)
    assert got[("menu_mismatch", "s2", "Another")] == 1 and sum(k[0] == "menu_mismatch" for k in got) == 1
    assert ("terminology", None, "email: Email, e-Mail") in got
    assert {k for k in got if k[0] == "spelling"} == {("spelling", "s2", "qzxv")}
    assert {k for k in got if k[0] == "hyphen_pair"} == {("hyphen_pair", "s3", "mis-quoted")}
    assert got[("duplicate_paragraph", "s1", "2")] == 1 and ("doubled_words", "s1", "the") in got
    assert ("spacing", "s2", "missing_space") in got
    assert not {k[0] for k in got} & {"untranslated", "acronym", "radio_guidance", "accessible_path", "titles"}


def test_other_language(course):
    got = found(course, english=False)
    kinds = {k[0] for k in got}
    assert not kinds & {"spelling", "hyphen_pair", "terminology"}
    assert "untranslated" in kinds
    assert ("untranslated", "s4", "answer") in got or ("untranslated", "s4", "of") in got


def test_dual_path(course):
    got = found(course, dual_path=True)
    assert {k for k in got if k[0] == "radio_guidance"} == {("radio_guidance", "s3", "1")}
    assert {k for k in got if k[0] == "acronym"} == {("acronym", "s3", "A B C")}
    assert not any(k[0] in ("duplicate_paragraph", "accessible_path") for k in got)


def test_dual_path_without_a_path(course, spark):
    alone = course["screens"].filter("scene_number = 1")
    got = found(course, screens=alone, dual_path=True)
    assert sum(k[0] == "accessible_path" for k in got) == 1
    # The whole course is looked at instead.
    assert ("radio_guidance", "s1", "1") in got and ("acronym", "s2", "A B C") in got


def test_without_vocabulary_and_without_rows(course):
    got = found(course, vocabulary=None, menu=None)
    assert not {k[0] for k in got} & {"spelling", "terminology", "menu_mismatch"} and ("doubled_words", "s1", "the") in got
    empty = {k: v.limit(0) for k, v in course.items() if k != "vocabulary"}
    assert not found({**empty, "vocabulary": course["vocabulary"]}, dual_path=True)


def test_one_pass_marks(course):
    kinds = Counter(r.kind for r in screen_pass(screen_texts(course["rows"]), True).collect())
    assert kinds["paragraph"] == 3 and kinds["pair"] == 3 and kinds["acronym"] == 3
    assert set(kinds) == {"doubled_words", "spacing", "paragraph", "acronym", "word", "pair"}


@pytest.mark.parametrize("how", [{}, {"dual_path": True}, {"english": False}])
def test_texts_are_written_once(course, monkeypatch, how):
    kept = {}

    def stored(df, name, write=package_report.stored):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(package_report, "stored", stored)
    run_all_checks(**{**course, **how})
    said = {name for name, df in kept.items() if any("This long paragraph" in str(r) for r in df.collect())}
    assert said == {"screen-texts"}


def test_runs_of_whole_screens(spark):
    rows = spark.createDataFrame([("c", "s1", 1, "en", "b"), ("c", "s1", 0, "en", "a"), ("c", "s2", 0, "fr", "x"), ("c", "s2", 0, "en", "x"), (None, "s1", 0, "en", "n"),
                                  (None, "s1", 1, "en", "m"), ("c", None, 0, "en", "z")], "course_id string, slide_id string, ord int, lang string, value string")
    # The same runs by screens: s1 and the screens without a course come in two rows, s3 has no run.
    parts = rows.groupBy("course_id", "slide_id", F.when(F.col("slide_id") == "s1", F.col("ord")).alias("part")).agg(
        F.collect_list(F.struct("ord", "value", "lang")).alias("told")).drop("part")
    empty = spark.createDataFrame([("c", "s3", [])], parts.schema)
    assert sorted(map(str, screen_runs(parts.unionByName(empty)).collect())) == sorted(map(str, screen_runs(rows).collect()))


@pytest.mark.parametrize("english", [True, False])
def test_common_words_change_nothing(course, english):
    words = course["vocabulary"]
    common = words.lexicon.filter("word IN ('the', 'answer', 'of', 'mot', 'course', 'go')")
    short = Vocabulary(**{**vars(words), "common": common})
    assert found(course, english=english) == found(course, english=english, vocabulary=short)


def test_checks_are_planned_a_few_at_a_time(course):
    report = run_all_checks(**course, dual_path=True)
    assert "Exchange" not in report._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("dual_path", [False, True])
def test_only_fixed_lists_are_sent_to_the_driver(course, monkeypatch, dual_path):
    """Tables with a row per screen, course or word are merged, however small their files are."""
    plans, write = [], package_report.stored

    def watched(df, name):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] if name in ("findings", "checked-screens", "checked-objects") else [])
        return write(df, name)

    monkeypatch.setattr(package_report, "stored", watched)
    words = course["vocabulary"]
    words.lexicon, words.never_spaced = write(words.lexicon, "test"), write(words.never_spaced, "test")
    written = {k: write(course[k], "test") for k in ("packages", "overrides", "objects", "questions", "menu")}
    assert found({**course, **written}, dual_path=dual_path)
    assert len(plans) > 3 and "SortMergeJoin" in "".join(plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]
