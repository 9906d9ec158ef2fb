"""All checks of course packages as one findings table.

Every screen's text is written once, as the array of its runs; no check reads the base tables again.  What several
checks read of it (findings of one screen, acronyms, hyphenated pairs) is written too; paragraphs, as digests, and words
have one reader each, which takes them from the texts.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access as A
from ..operators import lexicon as L
from ..operators import sites
from ..operators import structure as S
from ..operators import text_checks as C
from ..operators.stored import merged, stored

FINDING = ["course_id", "check_id", "level", "slide_id", "message"]
LEAST_PARAGRAPH = 40
TOGETHER = 4
SCREEN = ["course_id", "slide_id"]


@dataclass
class Vocabulary:
    """Word lists of the language checks: a ``lexicon`` (lang, word), tables of one ``word`` column, terms and affixes.

    ``common`` are the lexicon's most used words (lang, word), see ``lexicon.unknown_words``."""

    lexicon: DataFrame
    always_spaced: DataFrame
    never_spaced: DataFrame
    ignored: DataFrame | None = None
    common: DataFrame | None = None
    allowed_pairs: DataFrame | None = None
    terms: dict[str, Sequence[str]] = field(default_factory=dict)
    prefixes: Sequence[str] = ()
    suffixes: Sequence[str] = ()
    adjacent_only: Sequence[str] = ()
    may_double: Sequence[str] = ()


def _rows(df: DataFrame, check: str, level, message, slide="slide_id") -> DataFrame:
    slide = F.col(slide) if slide else F.lit(None).cast("string")
    level = F.lit(level) if isinstance(level, str) else level
    return df.select("course_id", F.lit(check).alias("check_id"), level.alias("level"), slide.alias("slide_id"),
                     message.cast("string").alias("message"))


def _words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def screen_runs(rows: DataFrame) -> DataFrame:
    """One row per screen: ``told``, its text runs (ord, value and, where ``rows`` have it, lang) in order.

    ``rows`` are single runs, or hold in an array ``told`` the runs of a screen.  Of the latter only screens that come in
    several rows are brought together.  A screen's runs come from one payload.
    """
    if "told" not in rows.columns:
        run = F.struct(*[c for c in ("ord", "value", "lang") if c in rows.columns])
        return rows.groupBy(*SCREEN).agg(F.sort_array(F.collect_list(run)).alias("told"))
    rows = rows.select(*SCREEN, "told")
    parted = stored(rows.groupBy(*SCREEN).agg(F.count("*").alias("n")).filter("n > 1").select(*SCREEN), "parted-screens")
    named = F.col("course_id").isNotNull() & F.col("slide_id").isNotNull()
    parts = rows.join(parted, SCREEN, "left_semi").unionByName(rows.filter(~named))
    together = parts.groupBy(*SCREEN).agg(F.flatten(F.collect_list("told")).alias("told"))
    whole = rows.filter(named).join(parted, SCREEN, "left_anti").unionByName(together)
    return whole.filter(F.size("told") > 0).withColumn("told", F.sort_array("told"))


def _texts(told: DataFrame) -> DataFrame:
    runs = told.select(*SCREEN, F.transform("told", lambda r: r["value"]).alias("runs"))
    return runs.withColumn("text", F.array_join("runs", "\n"))


def screen_texts(rows: DataFrame) -> DataFrame:
    """One row per screen: its text runs in order and their join by line breaks."""
    return _texts(screen_runs(rows))


def screen_pass(texts: DataFrame, english: bool, adjacent_only: Sequence[str] = (), may_double: Sequence[str] = (),
                only: Collection[str] | None = None) -> DataFrame:
    """Findings and marks of every screen, from one reading of its text: ``course_id, slide_id, kind, key``.

    Kinds ``doubled_words`` and ``spacing`` are findings; ``paragraph`` (by its SHA-256), ``word``, ``acronym`` and ``pair``
    wait for other screens or word lists.  ``only`` names the kinds wanted.
    """
    def told(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    runs = F.col("runs")
    doubled = T.doubled_words(F.array_join(runs, " "), _words(adjacent_only), _words(may_double))
    spacing = F.flatten(F.transform(runs, lambda r: F.transform(C.spacing_array(r, english), lambda f: f["kind"])))
    kinds = {
        "doubled_words": F.when(F.size(doubled) > 0, F.array(F.array_join(doubled, ", "))).otherwise(_words(())),
        "spacing": spacing,
        "paragraph": F.transform(F.filter(runs, lambda r: F.length(r) >= LEAST_PARAGRAPH), lambda r: F.base64(F.unhex(F.sha2(r, 256)))),
        "acronym": F.array_distinct(F.flatten(F.transform(runs, T.all_caps_runs))),
    }
    if english:
        kinds |= {"word": L.candidate_array(runs), "pair": F.flatten(F.transform(runs, T.hyphen_pairs))}
    wanted = [told(k, keys) for k, keys in kinds.items() if only is None or k in only]
    return texts.select(*SCREEN, F.explode(F.concat(*wanted)).alias("m")).select(*SCREEN, "m.kind", "m.key")


def run_all_checks(packages: DataFrame, overrides: DataFrame, screens: DataFrame, rows: DataFrame, objects: DataFrame,
                   questions: DataFrame, english: bool = True, dual_path: bool = False, menu: DataFrame | None = None,
                   vocabulary: Vocabulary | None = None) -> DataFrame:
    """Union of every check's findings.

    ``rows`` are the screens' text runs, in either form of ``screen_runs``.  ``english`` courses have their terms, spelling, hyphenated pairs and dashes checked; others (``rows`` with a column
    ``lang``) are searched for untranslated English instead.  ``dual_path`` lets titles and paragraphs appear twice and adds
    the screen-reader checks: on the accessible path, or on the whole course (with one failure) where a course has none.
    ``menu`` (course_id, slide_id, display) is compared with the screens' titles.  Checks that need word lists are left out
    without a ``vocabulary``.
    """
    limit = 2 if dual_path else 1
    words = vocabulary
    screens = stored(screens, "screens")
    told = stored(screen_runs(rows), "screen-texts")
    texts = _texts(told)
    shared = ["doubled_words", "spacing", *(["pair"] if words else []), *(["acronym"] if words and dual_path else [])]
    marks = stored(screen_pass(texts, english, words.adjacent_only if words else (), words.may_double if words else (), shared), "screen-marks")

    def marked(kind: str, key: str) -> DataFrame:
        found = marks if kind in shared else screen_pass(texts, english, only=[kind])
        return found.filter(F.col("kind") == kind).select(*SCREEN, F.col("key").alias(key))

    local = marks.filter(F.col("kind").isin("doubled_words", "spacing"))
    parts = [
        _rows(S.course_overview(screens), "overview", "info", F.col("seat_minutes"), None),
        _rows(S.path_topology(S.with_path(screens)), "paths", F.when(F.col("topology") == "none", "warn").otherwise("info"),
              F.col("topology"), None),
        _rows(S.driver_markers(packages), "driver", F.col("level"), F.col("what"), None),
        _rows(S.config_facts(packages), "scoring", F.col("level"), F.concat_ws(": ", "what", "value"), None),
        _rows(S.speed_control(packages, overrides), "speed_control", F.col("level"), F.col("source"), None),
        _rows(S.option_order(questions).filter("NOT is_survey AND needs_check"), "option_order", "warn", F.col("question_id")),
        _rows(C.duplicate_titles(screens, ["course_id", "scene_id"], "slide_id", "slide_title", limit), "duplicate_title", "warn",
              F.col("n_screens"), None),
        _rows(C.duplicate_paragraphs(marked("paragraph", "value"), ["course_id"], "slide_id", "value", limit, 0),
              "duplicate_paragraph", "warn", F.col("n_screens"), "first_screen"),
        local.select("course_id", F.col("kind").alias("check_id"), F.lit("warn").alias("level"), "slide_id", F.col("key").alias("message")),
        _rows(S.predecessor_check(screens).withColumnRenamed("check_id", "__c"), "previous_button", F.col("level"), F.col("message")),
    ]
    if menu is not None:
        shown = menu.select(*SCREEN, "display").join(merged(screens.select(*SCREEN, "slide_title")), SCREEN)
        parts.append(_rows(sites.menu_vs_screen(shown, SCREEN, "display", "slide_title"), "menu_mismatch", "warn", F.col("display")))
    if words and english:
        mixed = C.term_consistency(texts, ["course_id"], "slide_id", "text", words.terms)
        forms = mixed.groupBy("course_id", "term").agg(F.array_join(F.sort_array(F.collect_list("form")), ", ").alias("forms"))
        parts.append(_rows(forms, "terminology", "warn", F.concat_ws(": ", "term", "forms"), None))
        unknown = L.unknown_words(marked("word", "word"), words.lexicon, words.ignored, words.common)
        parts.append(_rows(_per_course(unknown, "word"), "spelling", "warn", F.col("word")))
        allowed = words.allowed_pairs if words.allowed_pairs is not None else words.lexicon.select("word").limit(0)
        pairs = L.suspicious_tokens(marked("pair", "token"), words.lexicon, allowed, words.prefixes, words.suffixes)
        parts.append(_rows(_per_course(pairs, "token"), "hyphen_pair", "warn", F.col("token")))
    elif words and "lang" in told.schema["told"].dataType.elementType.names:
        foreign = L.untranslated(told.select(*SCREEN, F.inline("told")), [*SCREEN, "ord"], "lang", "value", words.lexicon,
                                 common=words.common)
        parts.append(_rows(foreign, "untranslated", "warn", F.col("first_word")))
    if dual_path:
        alternate = S.alternate_scenes(screens).select("course_id", "scene_id")
        has = alternate.select("course_id").distinct()
        without = screens.select("course_id").distinct().join(merged(has), "course_id", "left_anti")
        parts.append(_rows(without, "accessible_path", "fail", F.lit("dual path, but no accessible path found"), None))
        scope = stored(screens.join(merged(alternate), ["course_id", "scene_id"], "left_semi").select(*SCREEN)
                       .unionByName(screens.join(merged(without), "course_id", "left_semi").select(*SCREEN)), "checked-screens")
        inside = stored(objects.join(merged(scope), SCREEN, "left_semi"), "checked-objects")
        radio = S.radio_without_guidance(questions.join(merged(scope), SCREEN, "left_semi"), texts.select(*SCREEN, F.col("runs").alias("texts")))
        parts += [
            _rows(A.tab_findings(inside), "tab_order", F.col("level"), F.col("what")),
            _rows(A.tab_duplicates(inside), "tab_duplicates", "warn", F.col("tab_index")),
            _rows(A.reading_order(inside), "reading_order", "warn", F.col("direction")),
            _rows(A.title_check(screens.join(merged(scope), SCREEN, "left_semi"), A.screen_title_guess(inside))
                  .filter("internal OR mismatch"), "titles", "warn", F.when(F.col("internal"), "internal").otherwise("mismatch")),
            _rows(radio, "radio_guidance", "warn", F.col("n_questions")),
        ]
        if words:
            capitals = _per_course(marked("acronym", "word").join(merged(scope), SCREEN, "left_semi"), "word")
            named = L.unspaced_acronyms(capitals.select("word").distinct(), words.lexicon, words.always_spaced, words.never_spaced)
            parts.append(_rows(capitals.join(merged(named), "word"), "acronym", "warn", T.letter_spaced(F.col("word"))))
    # The driver plans a few checks at a time: one plan of all of them outgrows its memory.
    told = [stored(reduce(DataFrame.unionByName, parts[k:k + TOGETHER]), "findings") for k in range(0, len(parts), TOGETHER)]
    return reduce(DataFrame.unionByName, told)


def _per_course(uses: DataFrame, key: str) -> DataFrame:
    """One row per course and ``key``, with the first screen that uses it."""
    return uses.groupBy("course_id", key).agg(F.min("slide_id").alias("slide_id"))
