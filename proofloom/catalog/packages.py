"""Course structure over ``documents``: 25 documents in a row are a course of
five scenes, a document is a screen and its lines are the screen's objects.
``conversations`` give questions and ``customer`` package configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import table
from .texts import LINES, TITLES, rows, titles
from ..operators import access as A
from ..operators import structure as S
from ..operators.stored import stored


def screens(spark, sf, told=None):
    """A screen per document, of all or of those ``told``."""
    d = (table(spark, sf, "documents") if told is None else told).select("doc_id", "n_chars", "text")
    course, scene = F.floor(F.col("doc_id") / 25), F.floor(F.col("doc_id") / 5) % 5 + 1
    t = titles(spark, sf, told).select(F.col("doc_id").alias("base"), "title")
    base = d.select("doc_id", "n_chars", "text", course.alias("course_id"), scene.cast("int").alias("scene_number"),
                    (F.col("doc_id") % 5 + 1).cast("int").alias("slide_number"))
    odd = (F.col("scene_number") == 5) | ((F.col("scene_number") == 3) & (F.col("slide_number") == 1) & (F.col("course_id") % 3 == 1))
    back = F.when(F.col("scene_number") == 3, 5).when(F.col("scene_number") == 4, 15).otherwise(0)
    # The digest goes through the join, not the text.
    base = (base.withColumn("base", F.col("doc_id") - back).withColumn("digest", F.when(odd, F.md5(F.col("text").cast("binary"))))
            .drop("text").join(t, "base", "left"))
    own = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("base").cast("string"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("gotoplay", "gotoplay", "history_prev", "conditional", "unresolved", "none", "")]),
                        (F.col("n_chars") % 7 + 1).cast("int"))
    target = F.concat(F.lit("s"), (F.col("doc_id") - F.col("n_chars") % 7 - 1).cast("string"))
    return base.select(
        "course_id", F.col("doc_id").alias("ord"), "scene_number",
        F.concat(F.lit("sc"), F.col("course_id").cast("string"), F.lit("_"), F.col("scene_number").cast("string")).alias("scene_id"),
        F.when((F.col("scene_number") == 4) & (F.col("course_id") % 2 == 0), "Accessible - A01")
        .when((F.col("scene_number") == 5) & (F.col("course_id") % 4 == 0), "The accessible  path")
        .when(F.col("scene_number") == 5, "Accessibility basics").otherwise("").alias("scene_title"),
        "slide_number", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("slide_id"),
        F.when(odd, F.col("digest")).otherwise(F.concat(
            F.sha2(own, 256), F.sha2(F.concat(own, F.lit("+")), 256))).alias("slide_title"), own.alias("plain_title"),
        ((F.col("scene_number") <= 2) & (F.col("course_id") % 3 != 2)).alias("is_in_menu"),
        (F.col("n_chars") * 37).alias("duration_ms"), kind.alias("prev_nav_kind"),
        F.when(kind == "gotoplay", target).otherwise("").alias("prev_nav_target"),
        F.when(F.col("n_chars") % 4 == 0, 1).otherwise(0).alias("history_prev_buttons"))


def menu_items(spark, sf, told=None):
    """A leaf, a folder of one and two folders of several, per course with a menu."""
    s = (screens(spark, sf) if told is None else told).filter("is_in_menu")
    first = s.groupBy("course_id").agg(F.min("ord").alias("f"))
    course = F.col("course_id").cast("string")

    def item(o, parent, depth, slide):
        return F.struct(F.lit(o).alias("ord"), F.lit(parent).cast("int").alias("parent_ord"), F.lit(depth).alias("depth"), slide.alias("slide_id"))

    def screen(k):
        return F.concat(F.lit("s"), (F.col("f") + k).cast("string"))

    def scene(k):
        return F.concat(F.lit("sc"), course, F.lit(f"_{k}"))

    items = F.array(item(0, None, 0, screen(0)), item(1, None, 0, F.lit("folder")), item(2, 1, 1, screen(1)),
                    item(3, None, 0, scene(1)), *[item(2 + k, 3, 1, screen(k)) for k in (2, 3, 4)],
                    item(7, None, 0, scene(2)), *[item(3 + k, 7, 1, screen(k)) for k in (5, 6, 7, 8, 9)])
    return (first.select("course_id", F.explode(items).alias("i")).select("course_id", "i.*")
            .withColumn("display", F.concat(F.lit("Item "), F.col("slide_id"))))


def pathed(spark, sf):
    return S.with_path(screens(spark, sf))


def q_overview(spark, sf):
    return S.course_overview(screens(spark, sf))


def q_backfill(spark, sf):
    s = S.scene_title_backfill(screens(spark, sf), menu_items(spark, sf))
    return s.select("course_id", "scene_id", "scene_title").distinct()


def q_alternate(spark, sf):
    return S.alternate_scenes(screens(spark, sf))


def q_topology(spark, sf):
    return S.path_topology(pathed(spark, sf))


def q_align(spark, sf):
    return S.align_paths(pathed(spark, sf)).select("course_id", "slide_id", "standard_slide_id", "kind")


def _inventory(spark, sf, s):
    """Inventory of the written screens ``s``; paths, menu and alignment all read those."""
    p = stored(S.with_path(s), "pathed-screens")
    return S.screen_inventory(p, menu_items(spark, sf, s), stored(S.align_paths(p), "aligned"))


def q_inventory(spark, sf):
    return _inventory(spark, sf, stored(screens(spark, sf), "course-screens")).drop("ord")


def q_predecessor(spark, sf):
    return (S.predecessor_check(screens(spark, sf))
            .select("course_id", "check_id", "level", "screen_number", "slide_id", "message", F.col("evidence")["expected"].alias("expected")))


def q_route(spark, sf):
    """Each screen leads to the next and to the first of its scene; every 25th ends."""
    s = screens(spark, sf)
    to = F.array(F.concat(F.lit("s"), (F.col("ord") - F.col("slide_number") + 1).cast("string")),
                 F.concat(F.lit("s"), (F.col("ord") + 1).cast("string")))
    nodes = s.select("course_id", "ord", "slide_id", to.alias("targets"), ((F.col("ord") % 25 == 24) & (F.col("course_id") % 2 == 0)).alias("terminal"))
    return S.forward_route(nodes)


def objects(spark, sf, told=None):
    r = rows(spark, sf) if told is None else told
    n = F.length("value")
    return r.select(
        F.floor(F.col("doc_id") / 25).alias("course_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("slide_id"),
        F.when(F.col("ord") % 3 == 2, "overlay").otherwise("base").alias("layer_id"), (F.col("ord") % 3 != 2).alias("is_base"), "ord",
        F.concat(F.lit("o"), F.lpad(F.col("ord").cast("string"), 5, "0")).alias("obj_id"),
        F.when(n % 4 == 0, "button").when(n % 4 < 3, "text").otherwise("").alias("acc_type"),
        F.when(n % 5 == 0, -1).otherwise(n % 7).alias("tab_index"), (n % 6 != 0).alias("tab_enabled"),
        F.lit("").alias("reference_name"), F.when(n % 7 == 0, "").otherwise(F.col("value")).alias("text"), F.lit("").alias("alt_text"),
        (n % 3 == 0).alias("has_click_event"), (n * 13 % 200).cast("double").alias("x_pos"), (n * 29 % 7 * 40).cast("double").alias("y_pos"))


def q_tab_findings(spark, sf):
    return A.tab_findings(objects(spark, sf))


def q_tab_duplicates(spark, sf):
    return A.tab_duplicates(objects(spark, sf))


def q_reading_order(spark, sf):
    return A.reading_order(objects(spark, sf))


def q_dialogs(spark, sf):
    layers = objects(spark, sf).groupBy("course_id", "slide_id", "layer_id").agg(F.count("*").alias("n"))
    layers = layers.select("course_id", F.when(F.col("layer_id") == "overlay", "dialog").otherwise("").alias("present_as"),
                           F.when(F.col("n") > 3, "label").otherwise("").alias("labeled_by_id"))
    return A.dialog_labels(layers)


def q_title_guess(spark, sf):
    return A.screen_title_guess(objects(spark, sf))


def q_title_check(spark, sf):
    s = screens(spark, sf).withColumn("slide_title", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("Slide_"), F.col("plain_title")))
                                      .otherwise(F.regexp_replace("plain_title", " [0-9]+$", "")))
    return A.title_check(s, A.screen_title_guess(objects(spark, sf)))


def questions(spark, sf):
    """A turn is a question; its first four words are the choices, labelled four ways."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    words = F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 4)
    style = (F.col("conv_id") + F.col("turn")) % 5
    letters, mixed = ["A. ", "B. ", "C. ", "D. "], ["B) ", "A) ", "D) ", "C) "]
    numbers, gap = ["12. ", "11. ", "13. ", "14. "], ["A. ", "C. ", "D. ", "E. "]

    def label(i):
        pick = F.lit("")
        for k, labels in ((3, gap), (2, numbers), (1, mixed), (0, letters)):
            pick = F.when(style == k, F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1)).otherwise(pick)
        return pick

    choices = F.transform(words, lambda w, i: F.struct(F.concat(F.lit("choice_"), i.cast("string")).alias("id"),
                                                       F.concat(label(i), w).alias("text")))
    return c.select(F.col("conv_id").alias("course_id"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("slide_id"),
                    F.col("turn").alias("ord"), F.col("text").alias("question_text"),
                    F.when(F.col("role") == "system", "truefalse").when(F.col("role") == "user", "multiplechoice")
                    .otherwise("multipleresponse").alias("question_type"), (F.col("turn") % 4 == 3).alias("is_survey"), choices.alias("choices"))


def q_option_order(spark, sf):
    q = S.option_order(questions(spark, sf))
    return (q.groupBy("course_id", "slide_id", "verified", "needs_check",
                      F.array_join(F.transform("choices", lambda x: x["text"]), " | ").alias("shown")).agg(F.count("*").alias("n")))


def q_radio(spark, sf):
    c = table(spark, sf, "conversations")
    s = c.select(F.col("conv_id").alias("course_id"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("slide_id"),
                 F.when(F.length("text") % 2 == 0, F.array("text", F.lit("Use the Tab key to move."))).otherwise(F.array("text")).alias("texts"))
    return S.radio_without_guidance(questions(spark, sf), s).select("course_id", "slide_id", "n_questions")


def q_question_kind(spark, sf):
    q = questions(spark, sf)
    text = F.concat(F.element_at(F.array(F.lit("Knowledge check: "), F.lit("The PreTest "), F.lit("final quiz "), F.lit("")),
                                 (F.col("ord") % 4 + 1).cast("int")), F.col("question_type"))
    return q.select("course_id", S.question_kind(text).alias("kind")).groupBy("course_id", "kind").agg(F.count("*").alias("n"))


def q_drivable(spark, sf):
    q = questions(spark, sf).select(
        "course_id", "is_survey", F.when(F.col("ord") == 1, "essay").when(F.col("ord") == 2, "matching").otherwise(F.col("question_type")).alias("question_type"),
        (F.col("course_id") % 2).alias("n_pairs"), (F.length("question_text") % 3).alias("n_unbound"),
        F.when(F.col("course_id") % 3 == 0, "").otherwise("submit").alias("submit_obj"))
    return S.question_drivable(q).groupBy("course_id", "drivable", "reason").agg(F.count("*").alias("n"))


def _class_input(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    return d.select(
        F.floor(F.col("doc_id") / 25).alias("course_id"), "doc_id", (n % 11 == 0).alias("text_entry"),
        F.when(n % 7 == 0, "next").alias("auto_advance"), (n % 13 == 0).alias("terminal"), (n % 5).alias("n_clickables"),
        (n % 3).alias("n_continue"), F.least(n % 3, n % 2).alias("n_continue_base"), (n % 4).alias("n_required_any"), F.lit(0).alias("n_auto_revealed"),
        (n % 2 == 0).alias("has_key"), (n % 9 == 0).alias("has_submit"), (n % 2).alias("n_questions"))


def q_screen_class(spark, sf):
    c = S.screen_class(_class_input(spark, sf))
    return c.select("doc_id", "automation", F.array_join("review_reasons", "; ").alias("reasons"))


def q_totals(spark, sf):
    return S.automation_totals(S.screen_class(_class_input(spark, sf)))


def packages(spark, sf):
    c = table(spark, sf, "customer")
    b, k = F.floor("c_acctbal").cast("bigint"), F.col("c_custkey")
    js = F.when(k % 17 == 0, "").otherwise(F.concat(
        F.lit("//driver\n"), F.when(k % 3 != 0, 'x("cmi.completion_status");').otherwise(""), F.when(k % 2 != 0, '("cmi.score.scaled")').otherwise(""),
        F.when(k % 5 != 0, '("cmi.score.raw")("cmi.suspend_data")').otherwise(""), F.when(k % 7 != 0, "LMSCommit();").otherwise(""),
        F.when(k % 4 == 1, "var DEFAULT_EXIT_TYPE = EXIT_TYPE_SUSPEND;").when(k % 4 == 2, "var  DEFAULT_EXIT_TYPE=EXIT_TYPE_FINISH;").otherwise(""),
        F.when(k % 6 == 1, 'var FORCED_COMMIT_TIME = "0";').when(k % 6 == 2, "var FORCED_COMMIT_TIME = 60000;").otherwise("")))
    scoring = F.concat(F.lit('{"type":"quiz","passPercent":'), (k % 100).cast("string"), F.lit(',"passStatus":"passed","viewThreshold":'),
                       (b % 10).cast("string"), F.lit("}"))
    quiz = F.concat(F.lit('{"lmstext":"Quiz '), k.cast("string"), F.lit('","issurvey":'), (k % 3 == 0).cast("string"), F.lit("}"))
    none = F.array().cast("array<variant>")
    return c.select(k.alias("course_id"), js.alias("driver_js"),
                    F.when(k % 10 == 0, none).otherwise(F.array(F.parse_json(scoring))).alias("scoring_configs"),
                    F.array(F.parse_json(quiz)).alias("quiz_configs"),
                    F.when(b % 3 == 0, True).when(b % 3 == 1, False).alias("speed_control"),
                    F.array_compact(F.array(F.when(k % 2 == 0, "quiz"), F.when(k % 3 == 0, "restricted"))).alias("flags"))


def q_driver(spark, sf):
    return S.driver_markers(packages(spark, sf))


def q_config(spark, sf):
    return S.config_facts(packages(spark, sf))


def _overrides(spark, sf):
    c = table(spark, sf, "customer")
    return c.filter("c_nationkey < 10").select(F.col("c_custkey").alias("course_id"), F.when(F.col("c_nationkey") < 8, F.col("c_nationkey") < 4).alias("speed_control"))


def q_speed(spark, sf):
    return S.speed_control(packages(spark, sf), _overrides(spark, sf))


def _findings(s):
    prev = S.predecessor_check(s)
    labelled = s.filter("history_prev_buttons > 0").select(
        "course_id", *S.finding("title", "warn", F.lit(None).cast("string"), F.lit(None).cast("string"),
                                F.concat(F.lit("title is internal ("), S.screen_label(), F.lit(")"))))
    return prev.unionByName(labelled)


def q_attach(spark, sf):
    s = stored(screens(spark, sf), "course-screens")
    f = S.findings_to_screens(_findings(s), s)
    return f.groupBy("course_id", "on_slide", "check_id").agg(F.count("*").alias("n"))


def q_lookup(spark, sf):
    s = stored(screens(spark, sf), "course-screens")
    inv = _inventory(spark, sf, s)
    f = _findings(s).filter("slide_id IS NOT NULL").select("course_id", "slide_id", "check_id")
    return S.screen_lookup(f, inv).groupBy("course_id", "screen_id", "path", "check_id").agg(F.count("*").alias("n"))


def q_checklist(spark, sf):
    """Standing items come from the nations table: a nation's region names the flag."""
    n = table(spark, sf, "nation")
    templates = n.select(F.lit("standing").alias("kind"), F.col("n_nationkey").alias("ord"),
                         F.element_at(F.array(F.lit(""), F.lit("quiz"), F.lit("restricted"), F.lit("never"), F.lit("quiz")),
                                      (F.col("n_regionkey") + 1).cast("int")).alias("only_if"),
                         F.concat(F.lit("look at "), "n_name").alias("template"))
    d = S.driver_markers(packages(spark, sf)).withColumnRenamed("what", "check_id")
    return S.flagged_checklist(d, templates, packages(spark, sf))


def q_outline(spark, sf):
    """Document lines as an outline: headings by their length."""
    r = rows(spark, sf)
    n = F.length("value")
    level = F.when(n % 23 == 0, 1).when(n % 11 == 0, 2).when(n % 9 == 0, 3)
    text = F.when(level == 2, F.concat(F.lit("Screen "), (n % 5).cast("string"), F.lit(" of 9: "), "value")).when(
        level == 3, F.concat("value", F.lit(" (layer)"))).otherwise(F.col("value"))
    return S.outline_context(r.select("doc_id", "ord", level.alias("level"), text.alias("text")))


QUERIES = {
    "course_overview": q_overview, "scene_title_backfill": q_backfill, "alternate_scenes": q_alternate, "path_topology": q_topology,
    "align_paths": q_align, "screen_inventory": q_inventory, "predecessor_check": q_predecessor, "forward_route": q_route,
    "tab_findings": q_tab_findings, "tab_duplicates": q_tab_duplicates, "reading_order_jumps": q_reading_order, "dialog_labels": q_dialogs,
    "screen_title_guess": q_title_guess, "screen_title_check": q_title_check, "option_order": q_option_order, "radio_without_guidance": q_radio,
    "question_kind": q_question_kind, "question_drivable": q_drivable, "screen_class": q_screen_class, "automation_totals": q_totals,
    "driver_markers": q_driver, "config_facts": q_config, "speed_control": q_speed, "findings_to_screens": q_attach,
    "screen_lookup": q_lookup, "flagged_checklist": q_checklist, "outline_context": q_outline,
}

_SCREENS = TITLES + """, b AS (SELECT doc_id, n_chars, text, doc_id // 25 AS course_id, ((doc_id // 5) % 5 + 1)::INT AS scene_number, (doc_id % 5 + 1)::INT AS slide_number FROM documents),
  b2 AS (SELECT *, doc_id - CASE scene_number WHEN 3 THEN 5 WHEN 4 THEN 15 ELSE 0 END AS base,
    scene_number = 5 OR (scene_number = 3 AND slide_number = 1 AND course_id % 3 = 1) AS odd FROM b),
  scr AS (SELECT course_id, b2.doc_id AS ord, scene_number, 'sc' || course_id || '_' || scene_number AS scene_id,
    CASE WHEN scene_number = 4 AND course_id % 2 = 0 THEN 'Accessible - A01' WHEN scene_number = 5 AND course_id % 4 = 0 THEN 'The accessible  path' WHEN scene_number = 5 THEN 'Accessibility basics' ELSE '' END AS scene_title,
    slide_number, 's' || b2.doc_id AS slide_id, coalesce(title, '') || ' ' || base AS plain_title, CASE WHEN odd THEN md5(text) ELSE sha256(plain_title) || sha256(plain_title || '+') END AS slide_title,
    scene_number <= 2 AND course_id % 3 <> 2 AS is_in_menu, n_chars * 37 AS duration_ms, n_chars,
    CASE n_chars % 7 WHEN 2 THEN 'history_prev' WHEN 3 THEN 'conditional' WHEN 4 THEN 'unresolved' WHEN 5 THEN 'none' WHEN 6 THEN '' ELSE 'gotoplay' END AS kind,
    CASE WHEN scene_number = 3 AND course_id % 3 <> 2 OR scene_number = 4 AND course_id % 2 = 0 OR scene_number = 5 AND course_id % 4 = 0
      OR (scene_number = 4 AND course_id % 3 <> 2) THEN 'Accessible' WHEN scene_number <= 2 AND course_id % 3 <> 2 THEN 'Standard' ELSE 'Other' END AS path
    FROM b2 LEFT JOIN titles t ON t.doc_id = b2.base)"""
_ALIGNED = _SCREENS + """, al AS (SELECT course_id, slide_id, ord, scene_number, slide_number,
    CASE WHEN course_id % 3 = 2 OR (course_id % 3 = 1 AND scene_number = 3) THEN NULL WHEN course_id % 3 = 0 AND scene_number = 3 THEN 's' || (ord - 5)
      WHEN course_id % 3 = 1 AND scene_number = 4 THEN 's' || (ord - 15) WHEN course_id % 3 = 0 THEN 's' || (course_id * 25 + 9) ELSE 's' || (course_id * 25 + 4) END AS std,
    CASE WHEN course_id % 3 = 2 OR (course_id % 3 = 1 AND scene_number = 3) THEN 'only' WHEN scene_number = 3 OR (course_id % 3 = 1 AND scene_number = 4) THEN 'match' ELSE 'extra' END AS kind FROM scr WHERE path = 'Accessible')"""
_INV = _ALIGNED + """, inv AS (SELECT course_id, slide_id, CASE WHEN course_id % 3 = 2 OR scene_number > 2 THEN 'm?s?' WHEN scene_number = 1 AND slide_number < 3 THEN 'm0s' || slide_number
      WHEN scene_number = 1 THEN 'm1s' || (slide_number - 2) ELSE 'm2s' || slide_number END AS screen_id, scene_number || '.' || slide_number AS screen_number, path,
      coalesce((SELECT string_agg(scene_number || '.' || slide_number || CASE WHEN a.kind = 'extra' THEN ' (extra)' ELSE '' END, ', ' ORDER BY ord) FROM al a WHERE a.std = s.slide_id AND a.kind <> 'only'), '') AS alternate, 0 AS part
    FROM scr s WHERE path <> 'Accessible' UNION ALL SELECT course_id, slide_id, '', '', 'Accessible', scene_number || '.' || slide_number, 1 FROM al WHERE kind = 'only')"""
_PRED = """pred AS (SELECT course_id, 'previous_button' AS check_id, scene_number || '.' || slide_number AS screen_number, slide_id, coalesce(lag(slide_id) OVER w, '') AS expected,
    CASE WHEN kind = 'history_prev' THEN 'fail' WHEN lag(slide_id) OVER w IS NULL THEN NULL WHEN kind = 'gotoplay' AND n_chars % 7 = 1 THEN 'fail' WHEN kind IN ('conditional', 'unresolved', '') THEN 'warn' END AS level,
    CASE WHEN kind = 'history_prev' THEN 'history' WHEN kind = 'gotoplay' THEN 'wrong_target' WHEN kind = '' THEN 'no_data' ELSE 'unresolved' END AS message, kind
    FROM scr WINDOW w AS (PARTITION BY course_id ORDER BY ord)),
  predf AS (SELECT course_id, check_id, level, screen_number, slide_id, message, expected FROM pred WHERE level IS NOT NULL
    UNION ALL SELECT course_id, 'back_button', 'fail', scene_number || '.' || slide_number, slide_id, 'history', NULL FROM scr WHERE n_chars % 4 = 0)"""
_OBJ = LINES + """, obj AS (SELECT doc_id // 25 AS course_id, 's' || doc_id AS slide_id, CASE WHEN ord % 3 = 2 THEN 'overlay' ELSE 'base' END AS layer_id, ord, 'o' || lpad(ord::VARCHAR, 5, '0') AS obj_id,
    CASE length(value) % 4 WHEN 0 THEN 'button' WHEN 3 THEN '' ELSE 'text' END AS acc_type, CASE WHEN length(value) % 5 = 0 THEN -1 ELSE length(value) % 7 END::INT AS tab_index, length(value) % 6 <> 0 AS tab_enabled,
    CASE WHEN length(value) % 7 = 0 THEN '' ELSE value END AS text, length(value) % 3 = 0 AS click, (length(value) * 13 % 200)::DOUBLE AS x, (length(value) * 29 % 7 * 40)::DOUBLE AS y FROM lines)"""
_GUESS = _OBJ + """, tx AS (SELECT *, count(*) OVER (PARTITION BY slide_id) AS n_tx FROM obj WHERE layer_id = 'base' AND acc_type = 'text' AND text <> ''),
  cd AS (SELECT slide_id, arg_min({'y': y, 'l': length(text), 't': text}, (y, length(text), ord)) AS c FROM tx WHERE n_tx >= 2 AND y < 100 AND length(text) BETWEEN 3 AND 80
    AND NOT regexp_matches(text, '(?i)^\\s*(loading|please wait|wait|one moment|continue)\\s*[.…]*\\s*$') GROUP BY slide_id),
  guess AS (SELECT course_id, tx.slide_id, CASE WHEN bool_or(tx.y > c.y AND length(text) > c.l) THEN trim(any_value(c.t)) END AS on_screen_title FROM tx LEFT JOIN cd ON cd.slide_id = tx.slide_id GROUP BY 1, 2)"""
_CLS = """cls AS (SELECT doc_id // 25 AS course_id, doc_id, n_chars AS n, list_filter([CASE WHEN n_chars % 11 = 0 THEN 'text entry' END,
    CASE WHEN NOT r AND n_chars % 3 = 0 AND n_chars % 5 = 0 THEN 'nothing clickable' END, CASE WHEN NOT r AND n_chars % 3 = 0 AND n_chars % 5 > 0 THEN 'no forward control' END,
    CASE WHEN NOT r AND n_chars % 3 > 0 AND least(n_chars % 3, n_chars % 2) = 0 AND n_chars % 4 = 0 THEN 'continue on an unrevealed layer' END], lambda x: x IS NOT NULL) AS reasons
    FROM (SELECT *, n_chars % 7 = 0 OR (n_chars % 2 = 0 AND n_chars % 9 = 0) OR n_chars % 13 = 0 AS r FROM documents))"""
_DRV = """drv AS (SELECT c_custkey AS course_id, unnest(CASE WHEN c_custkey % 17 = 0 THEN [{'w': 'driver', 'l': 'fail'}] ELSE [
    {'w': 'completion_status', 'l': CASE WHEN c_custkey % 3 <> 0 THEN 'pass' ELSE 'fail' END}, {'w': 'score_scaled', 'l': CASE WHEN c_custkey % 2 <> 0 THEN 'pass' ELSE 'warn' END},
    {'w': 'score_raw', 'l': CASE WHEN c_custkey % 5 <> 0 THEN 'pass' END}, {'w': 'suspend_data', 'l': CASE WHEN c_custkey % 5 <> 0 THEN 'pass' ELSE 'fail' END},
    {'w': 'commit', 'l': CASE WHEN c_custkey % 7 <> 0 THEN 'pass' ELSE 'fail' END}, {'w': 'exit_type', 'l': CASE c_custkey % 4 WHEN 1 THEN 'pass' WHEN 2 THEN 'warn' END},
    {'w': 'auto_commit', 'l': CASE c_custkey % 6 WHEN 1 THEN 'warn' WHEN 2 THEN 'info' END}, {'w': 'success_status', 'l': 'warn'}] END) AS f FROM customer),
  drvf AS (SELECT course_id, f.w AS what, f.l AS level FROM drv WHERE f.l IS NOT NULL)"""
ORACLE = {
    "course_overview": f"""WITH {_SCREENS}, s AS (SELECT course_id, count(*) AS n_screens, sum(duration_ms)::BIGINT AS total_ms FROM scr GROUP BY 1)
      SELECT course_id, n_screens, total_ms, greatest(5, 5 * round_even(total_ms / 60000.0 / 5, 0))::INT AS seat_minutes FROM s""",
    "scene_title_backfill": f"""WITH {_SCREENS} SELECT DISTINCT course_id, scene_id, CASE WHEN is_in_menu THEN 'Item ' || scene_id ELSE scene_title END AS scene_title FROM scr""",
    "alternate_scenes": f"""WITH {_SCREENS} SELECT DISTINCT course_id, scene_id, CASE WHEN scene_number IN (4, 5) AND scene_title LIKE '%ccessible%' THEN 'name' ELSE 'structure' END AS by FROM scr WHERE path = 'Accessible'""",
    "path_topology": f"""WITH {_SCREENS}, c AS (SELECT course_id, count(*) FILTER (path = 'Standard') AS n_standard, count(*) FILTER (path = 'Accessible') AS n_accessible FROM scr GROUP BY 1)
      SELECT *, CASE WHEN n_standard > 0 AND n_accessible > 0 THEN 'both' WHEN n_standard > 0 THEN 'standard' WHEN n_accessible > 0 THEN 'accessible' ELSE 'none' END AS topology FROM c""",
    "align_paths": f"WITH {_ALIGNED} SELECT course_id, slide_id, std AS standard_slide_id, kind FROM al",
    "screen_inventory": f"WITH {_INV} SELECT * FROM inv",
    "predecessor_check": f"WITH {_SCREENS}, {_PRED} SELECT * FROM predf",
    "forward_route": """SELECT doc_id // 25 AS course_id, (doc_id % 25)::INT AS step, 's' || doc_id AS slide_id,
      CASE WHEN (doc_id // 25) % 2 = 0 THEN 'terminal' ELSE 'unknown_screen' END AS end_reason FROM documents""",
    "tab_findings": f"""WITH {_OBJ} SELECT course_id, slide_id, layer_id, obj_id, 'unreachable_button' AS what, 'fail' AS level FROM obj WHERE acc_type = 'button' AND NOT (tab_enabled AND tab_index >= 0)
      UNION ALL SELECT course_id, slide_id, layer_id, obj_id, 'click_on_text', 'warn' FROM obj WHERE acc_type = 'text' AND click
      UNION ALL SELECT course_id, slide_id, layer_id, obj_id, 'unnamed_stop', 'warn' FROM obj WHERE tab_enabled AND tab_index >= 0 AND text = ''""",
    "tab_duplicates": f"""WITH {_OBJ} SELECT course_id, slide_id, layer_id, tab_index, count(*) AS n_objects, min(obj_id) AS first_obj FROM obj WHERE tab_enabled AND tab_index >= 0 GROUP BY ALL HAVING count(*) > 1""",
    "reading_order_jumps": f"""WITH {_OBJ}, l AS (SELECT *, lead(obj_id) OVER w AS next_obj, lead(tab_index) OVER w AS next_tab_index, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM obj WHERE tab_enabled AND tab_index > 0
        WINDOW w AS (PARTITION BY slide_id, layer_id ORDER BY tab_index, ord))
      SELECT course_id, slide_id, layer_id, obj_id, tab_index, next_obj, next_tab_index, CASE WHEN dy < -20 THEN 'above' ELSE 'left of' END AS direction FROM l WHERE dy < -20 OR (abs(dy) <= 20 AND dx < -20)""",
    "dialog_labels": f"""WITH {_OBJ}, l AS (SELECT course_id, slide_id, layer_id, count(*) AS n FROM obj GROUP BY ALL)
      SELECT course_id, count(*) FILTER (layer_id = 'overlay') AS n_dialogs, count(*) FILTER (layer_id = 'overlay' AND n <= 3) AS n_unlabelled FROM l GROUP BY 1""",
    "screen_title_guess": f"WITH {_GUESS} SELECT * FROM guess",
    "screen_title_check": f"""WITH {_GUESS}, {_SCREENS.replace(LINES + ', ', '', 1)}, t AS (SELECT s.course_id, s.slide_id, trim(CASE WHEN s.ord % 4 = 0 THEN 'Slide_' || plain_title ELSE regexp_replace(plain_title, ' [0-9]+$', '') END) AS title, on_screen_title FROM scr s LEFT JOIN guess g ON g.slide_id = s.slide_id),
      k AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(on_screen_title), '[^a-z0-9]', '', 'g') AS z FROM t)
      SELECT course_id, slide_id, title, on_screen_title, contains(title, '_') OR starts_with(lower(title), 'copy of ') AS internal, coalesce(on_screen_title IS NOT NULL AND a <> '' AND NOT ends_with(z, a), false) AS mismatch, on_screen_title IS NULL AS no_title FROM k""",
    "option_order": """WITH w AS (SELECT *, list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 4) AS ws, (conv_id + turn) % 5 AS st FROM conversations),
      l AS (SELECT *, len(ws) AS k, CASE st WHEN 0 THEN ['A. ','B. ','C. ','D. '] WHEN 1 THEN ['B) ','A) ','D) ','C) '] WHEN 2 THEN ['12. ','11. ','13. ','14. '] WHEN 3 THEN ['A. ','C. ','D. ','E. '] ELSE ['','','',''] END AS lb FROM w),
      v AS (SELECT *, CASE st WHEN 0 THEN k >= 2 WHEN 1 THEN k IN (2, 4) WHEN 2 THEN k >= 2 ELSE false END AS verified FROM l),
      s AS (SELECT *, CASE WHEN verified AND st IN (1, 2) THEN CASE WHEN st = 1 AND k = 4 THEN [2, 1, 4, 3] WHEN k = 2 THEN [2, 1] WHEN k = 3 THEN [2, 1, 3] ELSE [2, 1, 3, 4] END ELSE range(1, k + 1) END AS ix FROM v)
      SELECT conv_id AS course_id, 'q' || turn AS slide_id, verified, NOT verified AND role <> 'system' AS needs_check, array_to_string(list_transform(ix, lambda i: lb[i] || ws[i]), ' | ') AS shown, count(*) AS n FROM s GROUP BY ALL""",
    "radio_without_guidance": """SELECT c.conv_id AS course_id, 'q' || c.turn AS slide_id, n AS n_questions FROM conversations c JOIN (SELECT conv_id, turn, count(*) AS n FROM conversations WHERE role IN ('user', 'system') AND turn % 4 <> 3 GROUP BY ALL) q
      ON q.conv_id = c.conv_id AND q.turn = c.turn WHERE length(text) % 2 <> 0 AND NOT regexp_matches(text, '(?i)\\btab\\b')""",
    "question_kind": "SELECT conv_id AS course_id, CASE turn % 4 WHEN 0 THEN 'knowledge check' WHEN 1 THEN 'pre-test' WHEN 2 THEN 'quiz' END AS kind, count(*) AS n FROM conversations GROUP BY ALL",
    "question_drivable": """WITH r AS (SELECT conv_id AS course_id, CASE WHEN turn % 4 = 3 THEN 'survey' WHEN turn = 1 THEN 'text entry' WHEN turn = 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'matching without pairs' END
        WHEN length(text) % 3 > 0 THEN 'unbound choice' WHEN conv_id % 3 = 0 THEN 'no submit control' END AS reason FROM conversations)
      SELECT course_id, reason IS NULL AS drivable, reason, count(*) AS n FROM r GROUP BY ALL""",
    "screen_class": f"WITH {_CLS} SELECT doc_id, CASE WHEN len(reasons) > 0 THEN 'review' ELSE 'auto' END AS automation, array_to_string(reasons, '; ') AS reasons FROM cls",
    "automation_totals": f"""WITH {_CLS} SELECT course_id, count(*) FILTER (len(reasons) = 0) AS n_auto, count(*) FILTER (len(reasons) > 0) AS n_review, sum(n % 2)::BIGINT AS n_questions, sum(n % 5)::BIGINT AS n_clickables FROM cls GROUP BY 1""",
    "driver_markers": f"WITH {_DRV} SELECT * FROM drvf",
    "config_facts": """SELECT c_custkey AS course_id, 'scoring' AS what, NULL AS value, 'warn' AS level FROM customer WHERE c_custkey % 10 = 0
      UNION ALL SELECT c_custkey, unnest(['type', 'passPercent', 'passStatus', 'failStatus', 'slidesViewedMode', 'viewThreshold']), unnest(['quiz', (c_custkey % 100)::VARCHAR, 'passed', '?', '?', (floor(c_acctbal)::BIGINT % 10)::VARCHAR]), 'info' FROM customer WHERE c_custkey % 10 <> 0
      UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'survey' ELSE 'graded quiz' END, '?% Quiz ' || c_custkey, 'info' FROM customer WHERE c_custkey % 10 <> 0""",
    "speed_control": """WITH s AS (SELECT c_custkey AS course_id, CASE floor(c_acctbal)::BIGINT % 3 WHEN 0 THEN true WHEN 1 THEN false END AS p, CASE WHEN c_nationkey < 8 THEN c_nationkey < 4 END AS o FROM customer)
      SELECT course_id, CASE coalesce(o, p) WHEN true THEN 'pass' WHEN false THEN 'fail' ELSE 'warn' END AS level, CASE WHEN o IS NOT NULL THEN 'author file' WHEN p IS NOT NULL THEN 'package' ELSE 'unknown' END AS source FROM s""",
    "findings_to_screens": f"""WITH {_SCREENS}, {_PRED}, lb AS (SELECT course_id, slide_id, CASE WHEN scene_title = '' THEN 'Scene ' || scene_number ELSE scene_title END || ' / ' || slide_title AS label, n_chars FROM scr)
      SELECT course_id, slide_id AS on_slide, check_id, count(*) AS n FROM predf GROUP BY ALL
      UNION ALL SELECT a.course_id, b.slide_id, 'title', count(*) FROM lb a JOIN lb b ON b.course_id = a.course_id AND contains(a.label, b.label) WHERE a.n_chars % 4 = 0 GROUP BY ALL""",
    "screen_lookup": f"""WITH {_INV}, {_PRED}, f AS (SELECT course_id, slide_id, check_id FROM predf)
      SELECT f.course_id, coalesce(screen_id, '') AS screen_id, coalesce(i.path, '') AS path, check_id, count(*) AS n FROM f LEFT JOIN inv i ON i.slide_id = f.slide_id GROUP BY ALL""",
    "flagged_checklist": f"""WITH {_DRV}, p AS (SELECT c_custkey AS course_id, unnest(list_filter(['', CASE WHEN c_custkey % 2 = 0 THEN 'quiz' END, CASE WHEN c_custkey % 3 = 0 THEN 'restricted' END], lambda x: x IS NOT NULL)) AS flag FROM customer)
      SELECT course_id, 'flagged' AS part, 0 AS ord, level || ': ' || what || ' (' || count(*) || ')' AS line FROM drvf WHERE level IN ('warn', 'fail') GROUP BY course_id, what, level
      UNION ALL SELECT course_id, 'standing', n_nationkey, 'look at ' || n_name FROM p JOIN nation ON flag = ['', 'quiz', 'restricted', 'never', 'quiz'][n_regionkey + 1]""",
    "outline_context": f"""WITH {LINES}, h AS (SELECT doc_id, ord, value, CASE WHEN length(value) % 23 = 0 THEN 1 WHEN length(value) % 11 = 0 THEN 2 WHEN length(value) % 9 = 0 THEN 3 END AS level FROM lines),
      c AS (SELECT *, last_value(CASE WHEN level = 1 THEN value END IGNORE NULLS) OVER w AS module, last_value(CASE WHEN level = 2 THEN value WHEN level = 1 THEN '' END IGNORE NULLS) OVER w AS screen,
        last_value(CASE WHEN level = 3 THEN value WHEN level < 3 THEN '' END IGNORE NULLS) OVER w AS layer FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT doc_id, ord, coalesce(module, '') AS module, coalesce(screen, '') AS screen, CASE WHEN coalesce(screen, '') = '' THEN '' ELSE (length(screen) % 5) || ' of 9' END AS counter, coalesce(layer, '') AS layer, value AS text FROM c WHERE level IS NULL""",
}
