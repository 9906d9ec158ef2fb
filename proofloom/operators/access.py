"""Keyboard and screen-reader checks over the objects of screens' layers.

Objects are rows (course_id, slide_id, layer_id, is_base, ord, obj_id, kind,
acc_type, tab_index, tab_enabled, reference_name, text, alt_text,
has_click_event, x_pos, y_pos); tab_index -1 means it has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .stored import merged
from .structure import COUNTER, INTERNAL_PREFIXES, PLACEHOLDER

LAYER = ["course_id", "slide_id", "layer_id"]
SAME_ROW = 20


def _name(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def tab_findings(objects: DataFrame) -> DataFrame:
    """Unreachable buttons (fail), clickable text, unnamed tab stops (warn)."""
    stop = F.col("tab_enabled") & (F.col("tab_index") >= 0)
    checks = F.array_compact(F.array(
        F.when((F.col("acc_type") == "button") & ~stop, F.struct(F.lit("unreachable_button").alias("what"), F.lit("fail").alias("level"))),
        F.when((F.col("acc_type") == "text") & F.col("has_click_event"),
               F.struct(F.lit("click_on_text").alias("what"), F.lit("warn").alias("level"))),
        F.when(stop & (_name("text", "alt_text", "reference_name") == ""),
               F.struct(F.lit("unnamed_stop").alias("what"), F.lit("warn").alias("level")))))
    return (objects.select(*LAYER, "obj_id", F.explode(checks).alias("f"))
            .select(*LAYER, "obj_id", "f.what", "f.level"))


def tab_duplicates(objects: DataFrame) -> DataFrame:
    """Tab indexes used more than once on one layer."""
    return (objects.filter(F.col("tab_enabled") & (F.col("tab_index") >= 0))
            .groupBy(*LAYER, "tab_index").agg(F.count("*").alias("n_objects"), F.min("obj_id").alias("first_obj"))
            .filter("n_objects > 1"))


def reading_order(objects: DataFrame) -> DataFrame:
    """Consecutive tab stops that jump back: clearly above, or on the same row
    clearly to the left.  A layer's stops come from one screen's payload."""
    w = Window.partitionBy(*LAYER).orderBy("tab_index", "ord")
    stops = objects.filter(F.col("tab_enabled") & (F.col("tab_index") > 0))
    pair = stops.select(*LAYER, "obj_id", "tab_index", "x_pos", "y_pos",
                        F.lead(F.struct("obj_id", "tab_index", "x_pos", "y_pos")).over(w).alias("n"))
    dx, dy = F.col("n.x_pos") - F.col("x_pos"), F.col("n.y_pos") - F.col("y_pos")
    way = (F.when(dy < -SAME_ROW, "above").when((F.abs(dy) <= SAME_ROW) & (dx < -SAME_ROW), "left of"))
    return (pair.withColumn("direction", way).filter(F.col("direction").isNotNull())
            .select(*LAYER, "obj_id", "tab_index", F.col("n.obj_id").alias("next_obj"),
                    F.col("n.tab_index").alias("next_tab_index"), "direction"))


def dialog_labels(layers: DataFrame) -> DataFrame:
    """Per course: dialog layers and how many have no label."""
    dialog = F.col("present_as") == "dialog"
    return layers.groupBy("course_id").agg(
        F.count_if(dialog).alias("n_dialogs"),
        F.count_if(dialog & (F.coalesce("labeled_by_id", F.lit("")) == "")).alias("n_unlabelled"))


def internal_title(title: Column) -> Column:
    low = F.lower(F.trim(title))
    hit = F.contains(low, F.lit("_"))
    for p in INTERNAL_PREFIXES:
        hit = hit | F.startswith(low, F.lit(p))
    return hit


def screen_title_guess(objects: DataFrame) -> DataFrame:
    """On-screen title of each screen: the topmost, then shortest short text
    near the top of the base layer that has a longer text below it.

    A screen's texts are gathered into one array; they come from one payload.
    """
    texts = objects.filter(F.col("is_base") & (F.col("acc_type") == "text") & (F.coalesce("text", F.lit("")) != ""))
    per = texts.groupBy("course_id", "slide_id").agg(F.sort_array(F.collect_list(F.struct(
        "y_pos", F.length("text").alias("len"), "ord", "text"))).alias("ts"))
    cand = F.get(F.filter("ts", lambda o: (o["y_pos"] < 100) & o["len"].between(3, 80)
                          & ~o["text"].rlike(PLACEHOLDER) & ~o["text"].rlike(COUNTER)), F.lit(0))
    per = per.withColumn("c", F.when(F.size("ts") >= 2, cand))
    body = F.exists("ts", lambda o: (o["y_pos"] > F.col("c.y_pos")) & (o["len"] > F.col("c.len"))
                    & ~o["text"].rlike(PLACEHOLDER))
    return per.select("course_id", "slide_id", F.when(body, F.trim("c.text")).alias("on_screen_title"))


def title_check(screens: DataFrame, guesses: DataFrame) -> DataFrame:
    """Screens whose own title is internal or does not end the on-screen title."""
    rows = screens.select("course_id", "slide_id", F.trim(F.coalesce("slide_title", F.lit(""))).alias("title")).join(
        merged(guesses), ["course_id", "slide_id"], "left")
    mine, shown = T.alnum_key(F.col("title")), T.alnum_key(F.col("on_screen_title"))
    differs = F.col("on_screen_title").isNotNull() & (mine != "") & ~F.endswith(shown, mine)
    return rows.select("course_id", "slide_id", "title", "on_screen_title",
                       internal_title(F.col("title")).alias("internal"), differs.alias("mismatch"),
                       F.col("on_screen_title").isNull().alias("no_title"))
