"""Structure of course packages: navigation, paths, inventory, options, findings.

Tables are keyed by course_id: screens (ord, scene_number, scene_id,
scene_title, slide_number, slide_id, slide_title, lms_id, is_in_menu,
duration_ms, prev_nav_kind, prev_nav_target, history_prev_buttons), questions
(choices as an array of structs), menu_items (ord, parent_ord, depth, ...).
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .spread import previous_row, running_sum
from .stored import merged

# Thresholds and cue words of the path and title checks.
MATCH_RATIO, LOOK_AHEAD = 0.55, 5
INTERNAL_PREFIXES = ("acc_", "layer_", "slide_", "tmp_", "copy of ")
PLACEHOLDER = r"(?i)^\s*(loading|please wait|wait|one moment|continue)\s*[.…]*\s*$"
COUNTER = r"(?i)^\s*(screen|question|page|slide|step)\s+(?:\d+|%[^%\s]+%)\s+of\s+(?:\d+|%[^%\s]+%)\s*$"
TAB_CONTEXT = (r"(?iU)\b(arrow|select|selects|move|moving|key|keys|choice|choices|option|options|"
               r"answer|answers)\b")
RADIO_TYPES = ("multiplechoice", "truefalse")


def screen_number(scene: str = "scene_number", slide: str = "slide_number") -> Column:
    return F.concat_ws(".", F.col(scene).cast("string"), F.col(slide).cast("string"))


def finding(check: str, level: Column | str, screen: Column, slide: Column, message: Column,
            **evidence: Column) -> list[Column]:
    """Columns of one structured finding; evidence is a map of strings."""
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return [F.lit(check).alias("check_id"), (F.lit(level) if isinstance(level, str) else level).alias("level"),
            screen.alias("screen_number"), slide.alias("slide_id"), message.alias("message"),
            (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("evidence")]


# -- overview ---------------------------------------------------------------

def course_overview(screens: DataFrame) -> DataFrame:
    """Screens and estimated seat time: the timeline to the nearest five minutes
    (halves to even, five at least), or 1.5 minutes a screen without one."""
    sums = screens.groupBy("course_id").agg(
        F.count("*").alias("n_screens"), F.sum("duration_ms").alias("total_ms"))
    minutes = F.col("total_ms") / 60000
    timed = F.greatest(F.lit(5), F.lit(5) * F.bround(minutes / 5).cast("int"))
    return sums.select("course_id", "n_screens", "total_ms", F.when(F.col("total_ms") > 0, timed).otherwise(
        F.bround(F.col("n_screens") * 1.5).cast("int")).alias("seat_minutes"))


def scene_title_backfill(screens: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Scene titles taken from top-level menu entries that have children."""
    parents = menu_items.filter(F.col("parent_ord").isNotNull()).select(
        "course_id", F.col("parent_ord").alias("ord")).distinct()
    titles = (menu_items.filter(F.col("depth") == 0).join(parents, ["course_id", "ord"], "left_semi")
              .groupBy("course_id", F.col("slide_id").alias("scene_id"))
              .agg(F.max_by("display", "ord").alias("__title")))
    return (screens.join(titles, ["course_id", "scene_id"], "left")
            .withColumn("scene_title", F.coalesce("__title", "scene_title")).drop("__title"))


def alternate_scenes(screens: DataFrame) -> DataFrame:
    """Scenes of the accessible path (course_id, scene_id, by).

    Named so, or without menu screens but repeating two or more titles of
    scenes that have some.
    """
    named = F.coalesce(F.col("scene_title").rlike(r"(?iU)accessible\s*path|^\s*accessible\b"), F.lit(False))
    rows = screens.select("course_id", "scene_id", "is_in_menu", "slide_title", named.alias("named"),
                          T.normalise_title(F.col("slide_title")).alias("t"))
    key = ["course_id", "scene_id"]
    scene = rows.groupBy(*key).agg(F.bool_or("named").alias("named"), F.bool_or("is_in_menu").alias("menu"),
                                   F.count("*").alias("n"))
    menu_titles = (rows.filter(F.col("slide_title") != "").join(merged(scene.filter("menu").select(*key)), key, "left_semi")
                   .select("course_id", "t").distinct())
    shared = (rows.filter(F.col("slide_title") != "").join(merged(menu_titles), ["course_id", "t"], "left_semi")
              .groupBy(*key).agg(F.count("*").alias("n_shared")))
    by = (F.when(F.col("named"), "name").when(
        ~F.col("menu") & (F.col("n") >= 2) & (F.coalesce("n_shared", F.lit(0)) >= 2), "structure"))
    return scene.join(merged(shared), key, "left").select(*key, by.alias("by")).filter(F.col("by").isNotNull())


def with_path(screens: DataFrame) -> DataFrame:
    """Adds ``path``: Accessible, Standard (in a scene with menu screens) or Other."""
    key = ["course_id", "scene_id"]
    alt = alternate_scenes(screens).select(*key, F.lit(True).alias("__alt"))
    menu = screens.groupBy(*key).agg(F.bool_or("is_in_menu").alias("__menu"))
    flags = menu.join(merged(alt), key, "left")
    return (screens.join(merged(flags), key)
            .withColumn("path", F.when(F.col("__alt"), "Accessible").when(F.col("__menu"), "Standard").otherwise("Other"))
            .drop("__alt", "__menu"))


def path_topology(pathed: DataFrame) -> DataFrame:
    counts = pathed.groupBy("course_id").agg(
        F.count_if(F.col("path") == "Standard").alias("n_standard"),
        F.count_if(F.col("path") == "Accessible").alias("n_accessible"))
    std, acc = F.col("n_standard") > 0, F.col("n_accessible") > 0
    return counts.withColumn("topology", F.when(std & acc, "both").when(std, "standard")
                             .when(acc, "accessible").otherwise("none"))


def _align(course: pd.DataFrame, ahead: int) -> pd.DataFrame:
    """One course in screen order.  An accessible screen may take one of the
    standard screens from the last one taken to ``ahead`` places beyond it: the
    most alike, the nearest of equals."""
    course = course.sort_values("ord")
    side = {p: list(zip(g["slide_id"], g["t"])) for p, g in course.groupby("path")}
    standard, taken, at = side.get("Standard", []), None, 0
    rows = []
    for slide, title in side.get("Accessible", []):
        window = enumerate(standard[at:at + ahead + 1], at)
        score, back = max(((SequenceMatcher(None, title, t).ratio(), -i) for i, (_, t) in window if title and t), default=(0.0, 0))
        alike = score >= MATCH_RATIO
        if alike:
            at = -back
            taken = standard[at][0]
        rows.append((course["course_id"].iloc[0], slide, taken, "match" if alike else "extra" if taken is not None else "only",
                     score if alike else 0.0))
    return pd.DataFrame(rows, columns=["course_id", "slide_id", "standard_slide_id", "kind", "ratio"])


def align_paths(pathed: DataFrame, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Each accessible screen with its standard screen: match, extra (hangs on
    the last match) or only.

    The pass is sequential by nature, so a course is one group; it holds the
    screens of one package and only their ids and titles are sent.
    """
    rows = (pathed.filter(F.col("path") != "Other")
            .select("course_id", "ord", "slide_id", "path", T.normalise_title(F.col("slide_title")).alias("t")))
    schema = (f"course_id {pathed.schema['course_id'].dataType.simpleString()}, slide_id string, "
              "standard_slide_id string, kind string, ratio double")
    return rows.groupBy("course_id").applyInPandas(lambda course: _align(course, look_ahead), schema)


def screen_inventory(pathed: DataFrame, menu_items: DataFrame, aligned: DataFrame,
                     module_offset: int = 0) -> DataFrame:
    """Screen ids m<module>s<screen>.  Intro leaves and leading one-screen
    folders of the menu are module 0, screens off the menu m?s?, accessible
    screens are listed beside their standard screen, those without one last."""
    top = menu_items.filter(F.col("depth") == 0)
    kids = (menu_items.filter(F.col("depth") == 1)
            .groupBy("course_id", F.col("parent_ord").alias("ord"))
            .agg(F.count("*").alias("n_kids"), F.min_by("slide_id", "ord").alias("kid")))
    top = top.join(kids, ["course_id", "ord"], "left").withColumn("n_kids", F.coalesce("n_kids", F.lit(0)))
    # Modules start at the first folder with several screens.
    start = (top.filter("n_kids > 1").groupBy("course_id").agg(F.min("ord").alias("start")))
    top = top.join(start, "course_id", "left")
    before = F.col("start").isNull() | (F.col("ord") < F.col("start"))
    intro = (top.filter(before & (F.col("n_kids") <= 1))
             .select("course_id", F.when(F.col("n_kids") == 1, F.col("kid")).otherwise(F.col("slide_id")).alias("slide_id"))
             .distinct().withColumn("__intro", F.lit(True)))
    modules = top.filter(~before & (F.col("n_kids") > 0)).select(
        "course_id", F.col("slide_id").alias("scene_id"),
        F.row_number().over(Window.partitionBy("course_id").orderBy("ord")).alias("__module"))
    rows = (pathed.filter(F.col("path") != "Accessible").join(intro, ["course_id", "slide_id"], "left")
            .join(modules, ["course_id", "scene_id"], "left"))
    listed = F.coalesce(F.col("is_in_menu"), F.lit(False)) | F.col("__intro").isNotNull()
    module = F.when(F.col("__intro"), 0).otherwise(F.coalesce("__module", "scene_number") + module_offset)
    rows = rows.withColumn("module", F.when(listed, module))
    numbered = running_sum(rows, ["course_id", "module"], ["ord"], F.lit(1), F.col("scene_number"), "__s")
    beside = (aligned.filter("kind <> 'only'")
              .join(pathed.select("course_id", "slide_id", screen_number().alias("n"), F.col("ord").alias("o")), ["course_id", "slide_id"])
              .groupBy("course_id", F.col("standard_slide_id").alias("slide_id"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
                  "o", F.concat("n", F.when(F.col("kind") == "extra", " (extra)").otherwise("")).alias("n")))),
                  lambda s: s["n"]), ", ").alias("alternate")))
    main = (numbered.join(beside, ["course_id", "slide_id"], "left")
            .select("course_id", "ord", "slide_id", F.when(F.col("module").isNull(), "m?s?").otherwise(
                F.concat(F.lit("m"), F.col("module").cast("string"), F.lit("s"), F.col("__s").cast("string"))).alias("screen_id"),
                screen_number().alias("screen_number"), "path", F.coalesce("alternate", F.lit("")).alias("alternate"),
                F.lit(0).alias("part")))
    only = (aligned.filter("kind = 'only'").select("course_id", "slide_id")
            .join(pathed, ["course_id", "slide_id"])
            .select("course_id", "ord", "slide_id", F.lit("").alias("screen_id"), F.lit("").alias("screen_number"),
                    "path", screen_number().alias("alternate"), F.lit(1).alias("part")))
    return main.unionByName(only)


# -- navigation ---------------------------------------------------------------

def predecessor_check(screens: DataFrame) -> DataFrame:
    """Findings on Previous buttons: each should go to the screen before it.

    Returning to the last viewed screen fails anywhere; on the first screen
    nothing else is checked.
    """
    rows = screens.select("course_id", "scene_number", "slide_number", "slide_id", "slide_title",
                          "prev_nav_kind", "prev_nav_target", "history_prev_buttons")
    before = previous_row(rows, ["course_id"], ["scene_number", "slide_number", "slide_id"], ["slide_id"], F.col("scene_number"))
    kind = F.coalesce(F.col("prev_nav_kind"), F.lit(""))
    first = F.col("prev_slide_id").isNull()
    wrong = (kind == "gotoplay") & ~F.col("prev_nav_target").eqNullSafe(F.col("prev_slide_id"))
    level, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    cases = [(kind == "history_prev", "fail", "history"), (first, None, None), (wrong, "fail", "wrong_target"),
             (kind.isin("conditional", "unresolved"), "warn", "unresolved"), (kind == "", "warn", "no_data")]
    for cond, lv, w in reversed(cases):
        level = F.when(cond, F.lit(lv)).otherwise(level)
        what = F.when(cond, F.lit(w)).otherwise(what)
    prev = before.select("course_id", *finding(
        "previous_button", level, screen_number(), F.col("slide_id"), what,
        expected=F.coalesce("prev_slide_id", F.lit("")), target=F.coalesce("prev_nav_target", F.lit("")))
        ).filter(F.col("level").isNotNull())
    hist = rows.filter("history_prev_buttons > 0").select("course_id", *finding(
        "back_button", "fail", screen_number(), F.col("slide_id"), F.lit("history"), buttons=F.col("history_prev_buttons")))
    return prev.unionByName(hist)


def _route(screens: pd.DataFrame) -> pd.DataFrame:
    """Walk of one course from its first screen: each way out of a screen is
    taken once, ways to screens not seen yet before the others, in their order.
    Every way is used up at most once, so the walk ends by itself."""
    screens = screens.sort_values("ord")
    given = {r.slide_id: [t for t in (r.targets if r.targets is not None else []) if t] for r in screens.itertuples()}
    unused = {s: list(dict.fromkeys(ts)) for s, ts in given.items()}
    closing = set(screens.loc[screens["terminal"].fillna(False).astype(bool), "slide_id"])
    here, trail, seen, reason = screens["slide_id"].iloc[0], [], set(), "unknown_screen"
    while here in unused:
        trail.append(here)
        seen.add(here)
        if here in closing or not unused[here]:
            reason = "terminal" if here in closing else "edges_used" if given[here] else "no_forward_control"
            break
        onward = min(unused[here], key=seen.__contains__)
        unused[here].remove(onward)
        here = onward
    return pd.DataFrame({"course_id": screens["course_id"].iloc[0], "step": range(len(trail)), "slide_id": trail, "end_reason": reason})


def forward_route(nodes: DataFrame) -> DataFrame:
    """Deterministic route per course from (course_id, ord, slide_id, targets,
    terminal); sequential, so one group per course, ids only."""
    schema = (f"course_id {nodes.schema['course_id'].dataType.simpleString()}, step int, slide_id string, "
              "end_reason string")
    return (nodes.select("course_id", "ord", "slide_id", "targets", "terminal")
            .groupBy("course_id").applyInPandas(_route, schema))


# -- questions ----------------------------------------------------------------

def option_order(questions: DataFrame, choices: str = "choices") -> DataFrame:
    """Choices in on-screen order where their labels say so.

    Sorted by label when every choice has one, all letters from A or all
    consecutive numbers, none twice; otherwise as stored and ``verified`` is
    false.  True/false questions need no marker.
    """
    c = F.col(choices)
    token = lambda x: F.regexp_extract(x["text"], r"^\s*([A-Za-z]|\d{1,2})[.)]\s", 1)
    keys = F.transform(c, lambda x: F.upper(token(x)))
    letters = F.forall(keys, lambda k: k.rlike("^[A-Z]$"))
    numbers = F.forall(keys, lambda k: k.rlike(r"^\d+$"))
    rank = F.transform(keys, lambda k: F.when(k.rlike("^[A-Z]$"), F.ascii(k) - 64).otherwise(k.try_cast("int")))
    n = F.size(c)
    low = F.when(letters, F.lit(1)).otherwise(F.array_min(rank))
    whole = F.array_sort(rank) == F.sequence(low, low + n - 1)
    verified = F.when(n >= 2, F.coalesce((letters | numbers) & whole, F.lit(False))).otherwise(F.lit(False))
    sorted_choices = F.transform(
        F.array_sort(F.arrays_zip(rank.alias("rank"), c.alias("choice")),
                     lambda a, b: a["rank"] - b["rank"]), lambda z: z["choice"])
    return (questions.withColumn("verified", verified)
            .withColumn(choices, F.when(verified, sorted_choices).otherwise(c))
            .withColumn("needs_check", ~F.col("verified") & (F.col("question_type") != "truefalse")))


def radio_without_guidance(questions: DataFrame, screens: DataFrame) -> DataFrame:
    """Screens with a single-select graded question and no hint to use Tab."""
    radio = (questions.filter(~F.col("is_survey") & F.col("question_type").isin(*RADIO_TYPES))
             .groupBy("course_id", "slide_id").agg(F.min_by("question_text", "ord").alias("question_text"),
                                                   F.count("*").alias("n_questions")))
    said = F.array_join("texts", " ")
    hint = said.rlike(r"(?iU)\btab\b") & said.rlike(TAB_CONTEXT)
    return (radio.join(merged(screens.select("course_id", "slide_id", hint.alias("__hint"))), ["course_id", "slide_id"])
            .filter(~F.col("__hint")).drop("__hint"))


def question_kind(text: Column) -> Column:
    t = F.upper(text)
    return (F.when(F.contains(t, F.lit("KNOWLEDGE CHECK")), "knowledge check")
            .when(F.contains(t, F.lit("PRE-TEST")) | F.contains(t, F.lit("PRETEST")), "pre-test")
            .when(F.contains(t, F.lit("QUIZ")), "quiz"))


def question_drivable(questions: DataFrame) -> DataFrame:
    """Adds ``reason`` a question cannot be answered by a driver (null: it can).
    Columns: is_survey, question_type, n_pairs, n_unbound, submit_obj."""
    reason = (F.when(F.col("is_survey"), "survey")
              .when(F.col("question_type").isin("fillin", "essay", "shortanswer", "text"), "text entry")
              .when(F.col("question_type") == "matching", F.when(F.col("n_pairs") == 0, "matching without pairs"))
              .when(F.col("n_unbound") > 0, "unbound choice")
              .when(F.coalesce(F.col("submit_obj"), F.lit("")) == "", "no submit control"))
    return questions.withColumn("reason", reason).withColumn("drivable", F.col("reason").isNull())


def screen_class(screens: DataFrame) -> DataFrame:
    """Adds ``review_reasons`` and ``automation`` (auto or review).

    Columns: text_entry, auto_advance, terminal, n_clickables, n_continue,
    n_continue_base, n_required_any, n_auto_revealed, has_key, has_submit.
    """
    c = F.col
    reached = c("auto_advance").isNotNull() | (c("has_key") & c("has_submit")) | c("terminal")
    hidden = (c("n_continue") > 0) & (c("n_continue_base") == 0) & (c("n_required_any") == 0) & (c("n_auto_revealed") == 0)
    reasons = F.array_compact(F.array(
        F.when(c("text_entry"), "text entry"),
        F.when(~reached & (c("n_continue") == 0) & (c("n_clickables") == 0), "nothing clickable"),
        F.when(~reached & (c("n_continue") == 0) & (c("n_clickables") > 0), "no forward control"),
        F.when(~reached & hidden, "continue on an unrevealed layer")))
    return (screens.withColumn("review_reasons", reasons)
            .withColumn("automation", F.when(F.size("review_reasons") > 0, "review").otherwise("auto")))


def automation_totals(classified: DataFrame) -> DataFrame:
    return classified.groupBy("course_id").agg(
        F.count_if(F.col("automation") == "auto").alias("n_auto"),
        F.count_if(F.col("automation") == "review").alias("n_review"),
        F.sum("n_questions").alias("n_questions"), F.sum("n_clickables").alias("n_clickables"))


# -- package configuration ------------------------------------------------------

def driver_markers(packages: DataFrame) -> DataFrame:
    """Findings on what the API driver text sets and calls."""
    js = F.coalesce(F.col("driver_js"), F.lit(""))

    def has(*texts: str) -> Column:
        hit = F.lit(False)
        for t in texts:
            hit = hit | F.contains(js, F.lit(t))
        return hit

    exit_type = F.regexp_extract(js, r"var\s+DEFAULT_EXIT_TYPE\s*=\s*(\w+)", 1)
    interval = F.regexp_extract(js, r"var\s+FORCED_COMMIT_TIME\s*=\s*\"?(\d+)\"?", 1)

    def item(what: str, level: Column) -> Column:
        return F.when(level.isNotNull(), F.struct(F.lit(what).alias("what"), level.alias("level")))

    def present(what: str, missing: str | None, *texts: str) -> Column:
        return item(what, F.when(has(*texts), "pass").otherwise(F.lit(missing)))

    found = F.array_compact(F.array(
        present("completion_status", "fail", "SetValue.*cmi.completion_status", '"cmi.completion_status"'),
        present("score_scaled", "warn", '"cmi.score.scaled"'), present("score_raw", None, '"cmi.score.raw"'),
        present("suspend_data", "fail", '"cmi.suspend_data"'),
        present("commit", "fail", "CallCommit", "LMSCommit", "SCORM2004_CommitData"),
        item("exit_type", F.when(exit_type != "", F.when(F.contains(F.upper(exit_type), F.lit("SUSPEND")), "pass").otherwise("warn"))),
        item("auto_commit", F.when(interval != "", F.when(interval.rlike("^0+$"), "warn").otherwise("info"))),
        present("success_status", "warn", '"cmi.success_status"')))
    missing = F.array(F.struct(F.lit("driver").alias("what"), F.lit("fail").alias("level")))
    rows = F.when(js == "", missing).otherwise(found)
    return packages.select("course_id", F.explode(rows).alias("f")).select("course_id", "f.what", "f.level")


def config_facts(packages: DataFrame) -> DataFrame:
    """Scoring and quiz configuration as (course_id, what, value, level) rows.
    ``scoring_configs`` and ``quiz_configs`` are arrays of VARIANT."""
    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("c", f"$.{path}", kind)

    none = packages.filter(F.size("scoring_configs") <= 0).select(
        "course_id", F.lit("scoring").alias("what"), F.lit(None).cast("string").alias("value"), F.lit("warn").alias("level"))
    names = ("type", "passPercent", "passStatus", "failStatus", "slidesViewedMode", "viewThreshold")
    scoring = packages.select("course_id", F.explode("scoring_configs").alias("c")).select(
        "course_id", F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.coalesce(get(n), F.lit("?")).alias("value"))
                                         for n in names])).alias("f"))
    has_scoring = packages.filter(F.size("scoring_configs") > 0)
    quiz = has_scoring.select("course_id", F.explode("quiz_configs").alias("c")).select(
        "course_id", F.when(F.coalesce(get("issurvey", "boolean"), F.lit(False)), "survey").otherwise("graded quiz").alias("what"),
        F.concat(F.coalesce(get("passPercent"), F.lit("?")), F.lit("% "), F.coalesce(get("lmstext"), F.lit(""))).alias("value"))
    info = scoring.select("course_id", "f.what", "f.value").unionByName(quiz).withColumn("level", F.lit("info"))
    return none.unionByName(info)


def speed_control(packages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Playback speed: the author's setting wins over the package's."""
    o = overrides.select("course_id", F.col("speed_control").alias("__o"))
    rows = packages.select("course_id", "speed_control").join(merged(o), "course_id", "left")
    value = F.coalesce("__o", "speed_control")
    return rows.select("course_id", F.when(value, "pass").when(~value, "fail").otherwise("warn").alias("level"),
                       F.when(F.col("__o").isNotNull(), "author file").when(F.col("speed_control").isNotNull(), "package")
                       .otherwise("unknown").alias("source"))


# -- findings -------------------------------------------------------------------

def screen_label(scene_title: str = "scene_title") -> Column:
    scene = F.coalesce(F.nullif(F.col(scene_title), F.lit("")), F.concat(F.lit("Scene "), F.col("scene_number").cast("string")))
    return F.concat(scene, F.lit(" / "), F.coalesce("slide_title", F.lit("")))


def findings_to_screens(findings: DataFrame, screens: DataFrame) -> DataFrame:
    """Findings with the slide they are about.

    By screen number when a finding has one; otherwise by a screen label quoted
    in its message.  Labels contain " / ", so a label can only be quoted where
    the message has that mark between the same characters, which is the join key.
    """
    number = screens.select("course_id", screen_number().alias("screen_number"), F.col("slide_id").alias("on_slide"))
    by_number = findings.join(number, ["course_id", "screen_number"])
    rest = findings.join(number.select("course_id", "screen_number").distinct(), ["course_id", "screen_number"], "left_anti")
    labels = (screens.select("course_id", F.col("slide_id").alias("on_slide"), screen_label().alias("label"))
              .withColumn("mark", F.regexp_extract("label", r"(?s)(. / .?)", 1)))
    marks = F.array_distinct(F.concat(
        F.regexp_extract_all("message", F.lit(r"(?s)(?=(. / .))"), 1),
        F.regexp_extract_all("message", F.lit(r"(?s)(?=(. / ))"), 1)))
    quoted = rest.withColumn("mark", F.explode(marks))
    by_label = (quoted.join(labels, ["course_id", "mark"])
                .filter(F.contains("message", F.col("label"))).select(*findings.columns, "on_slide"))
    return by_number.select(*findings.columns, "on_slide").unionByName(by_label)


def screen_lookup(rows: DataFrame, inventory: DataFrame, key: str = "slide_id") -> DataFrame:
    """Screen id and path beside any table that names a screen; empty if unknown."""
    table = inventory.select("course_id", F.col("slide_id").alias(key), "screen_id", "path").distinct()
    return (rows.join(table, ["course_id", key], "left")
            .withColumn("screen_id", F.coalesce("screen_id", F.lit("")))
            .withColumn("path", F.coalesce("path", F.lit(""))))


def flagged_checklist(findings: DataFrame, templates: DataFrame, packages: DataFrame) -> DataFrame:
    """Checklist rows: what warned or failed, and the standing items that apply.

    ``templates`` (kind, ord, only_if, template): ``only_if`` empty, or a
    value that the package's ``flags`` array must contain.
    """
    flagged = (findings.filter(F.col("level").isin("warn", "fail"))
               .groupBy("course_id", "check_id", "level").agg(F.count("*").alias("n"))
               .select("course_id", F.lit("flagged").alias("part"), F.lit(0).alias("ord"),
                       F.concat("level", F.lit(": "), "check_id", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line")))
    asks = packages.select("course_id", F.explode(F.array_union(F.array(F.lit("")), F.col("flags"))).alias("only_if"))
    standing = (asks.join(templates, "only_if")
                .select("course_id", F.col("kind").alias("part"), "ord", F.col("template").alias("line")))
    return flagged.unionByName(standing)


# -- outline --------------------------------------------------------------------

def outline_context(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Body blocks with the module, screen and layer heading above them.

    Headings of level 1 to 3 open a module, screen or layer and close deeper
    ones; "Screen x of y: title" gives the counter apart.  A document's blocks
    are one reading, carried across chunks of its order.
    """
    heading = r"(?i)^\s*screen\s+(\d+)\s+of\s+(\d+)\s*[:.\-–—]?\s*(.*)$"
    level = F.col("level")
    rows = blocks.withColumn("__h", F.when(level.isin(1, 2, 3), F.col("text")))
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def above(at: int) -> Column:
        # A heading of a higher level resets the deeper ones.
        return F.last(F.when(level == at, F.col("text")).when((level < at) & (level >= 1), F.lit("")), ignorenulls=True).over(w)

    rows = rows.select("*", above(1).alias("module"), above(2).alias("__screen"), above(3).alias("__layer"))
    pill = F.when(F.col("__screen").rlike(heading), F.concat(
        F.regexp_extract("__screen", heading, 1), F.lit(" of "), F.regexp_extract("__screen", heading, 2))).otherwise("")
    named = F.regexp_extract("__screen", heading, 3)
    screen = F.when((pill != "") & (named != ""), named).otherwise(F.col("__screen"))
    layer = F.trim(F.regexp_replace("__layer", r"(?i)\s*\(layer\)\s*$", ""))
    return (rows.filter(level.isNull())
            .select(*keys, "ord", F.coalesce("module", F.lit("")).alias("module"), F.coalesce(screen, F.lit("")).alias("screen"),
                    F.coalesce(pill, F.lit("")).alias("counter"), F.coalesce(layer, F.lit("")).alias("layer"), "text"))
