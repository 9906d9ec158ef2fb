"""Nested package payloads: walks of any depth inside one row.

A payload is one screen's JSON text.  Walks along one field are folds over the
levels of that payload, as many as its own brackets nest, so no level is cut
off and nothing is shuffled.  Decode once, write the flat tables, and let every
check read those.
"""

from __future__ import annotations

import re
from json import loads

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

# Event and action kinds, group names and id shapes of the payloads.
CLICKS = ("onrelease", "onclick", "onpress", "ontouchend")
ADVANCES = ("gotoplay", "nextslide", "next_slide", "jumpto")
MEDIA = ("media_play", "media_pause", "media_toggle", "media_seek")
REVEALING = ("ontimelinecomplete", "ontimelinetick", "onslidestart", "ontransitionin")
PREVIOUS_GROUP, GATE_GROUP = "ActGrpOnPrevButtonClick", "NavigationRestrictionNextSlide_"
VISITED_GROUP = "ActGrpSetVisitedState"
VISITED = r"(?:^|\.)([0-9A-Za-z]{11})\.#_visited$"
STATE = r"(?:^|\.)([0-9A-Za-z]{11})\.#state$"


def get(node: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, f"$.{path}" if path else "$", kind)


def children(node: Column, path: str) -> Column:
    """An array field; a single object counts as an array of one, absent as none."""
    many = get(node, path, "array<variant>")
    one = F.when(get(node, path, "map<string,variant>").isNotNull(), F.array(get(node, path, "variant")))
    return F.coalesce(many, one, F.array().cast("array<variant>"))


def text_of(node: Column, path: str) -> Column:
    return F.coalesce(get(node, path), F.lit(""))


def nesting(json: Column) -> Column:
    """How deep the brackets of a JSON text nest, strings left out."""
    brackets = F.regexp_replace(json, r'"(?:\\.|[^"\\])*"|[^\[\]{}]+', "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda s: s["top"])


def walk(roots: Column, depth: Column, expand) -> Column:
    """All nodes reachable from ``roots`` (array of structs) by ``expand``, which
    maps one such struct to the array of its children, parents first."""
    start = F.struct(roots.alias("all"), roots.alias("front"))

    def step(s: Column, _: Column) -> Column:
        front = F.flatten(F.transform(s["front"], expand))
        return F.struct(F.concat(s["all"], front).alias("all"), front.alias("front"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), start, step, lambda s: s["all"])


def _at(i: Column) -> Column:
    """A number as text that sorts as the number does, of any size."""
    wide = F.concat(F.lit(":"), F.lpad(i.cast("string"), 10, "0"))
    return F.when(i < 100000, F.lpad(i.cast("string"), 5, "0")).otherwise(wide)


def numbered(nodes: Column, prefix: Column | None = None) -> Column:
    """Array of variants as (path, node) structs; paths sort in reading order."""
    return F.transform(nodes, lambda n, i: F.struct(
        (_at(i) if prefix is None else F.concat(prefix, F.lit("."), _at(i))).alias("path"), n.alias("node")))


def walk_field(roots: Column, field: str, depth: Column) -> Column:
    """(path, node) of ``roots`` and everything below them in ``field``."""
    return walk(numbered(roots), depth, lambda p: numbered(children(p["node"], field), p["path"]))


def children_of_list(node: Column) -> Column:
    return F.coalesce(get(node, "", "array<variant>"), F.array().cast("array<variant>"))


ACTION = ("layer_id string, is_base boolean, owner string, owner_path string, owner_kind string, acc_type string, "
          "event string, event_path string, action_group string, cond boolean, path string, kind string, id string, "
          "ref string, url string, value_a string, value_b string, hide_others boolean, pos int")


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value or "")


def _action_rows(node, path: str, ctx: dict, out: list) -> None:
    """Every object that has a kind, with what surrounds it: layer, owning
    object, event, action group and whether a condition is above it."""
    if isinstance(node, list):
        for i, item in enumerate(node):
            _action_rows(item, f"{path}/{i:05d}", ctx, out)
    if not isinstance(node, dict):
        return
    kind, ident = _text(node.get("kind")), _text(node.get("id"))
    if re.search(r"^/slideLayers/[0-9]+$", path):
        ctx = {**ctx, "layer_id": ident, "is_base": bool(node.get("isBaseLayer"))}
    if ident and any(k in node for k in ("events", "accType", "states")):
        ctx = {**ctx, "owner": ident, "owner_path": path, "owner_kind": kind, "acc_type": _text(node.get("accType"))}
    if kind.startswith("on"):
        ctx = {**ctx, "event": kind, "event_path": path}
    if kind:
        ref = node.get("objRef")
        out.append({**ctx, "path": path, "pos": len(out), "kind": kind, "id": ident, "url": _text(node.get("url")),
                    "ref": _text(ref.get("value")).split(".")[-1] if isinstance(ref, dict) else "",
                    "value_a": _text(node.get("valuea")), "value_b": _text(node.get("valueb")),
                    "hide_others": _text(node.get("hideOthers")) in ("true", "all", "oncomplete")})
    inner = {**ctx, "cond": ctx["cond"] or kind == "if_action"}
    for key, value in node.items():
        if key == "actionGroups" and isinstance(value, dict):
            for name, group in value.items():
                at = {**inner, "action_group": name}
                out.append({**at, "path": f"{path}/{key}/{name}", "pos": len(out), "kind": "action_group", "id": name})
                _action_rows(group, f"{path}/{key}/{name}", at, out)
        else:
            _action_rows(value, f"{path}/{key}", inner, out)


def actions(slides: DataFrame, *keys: str, json: str = "payload") -> DataFrame:
    """All actions, events and compares of screens' payloads as flat rows; ``pos``
    numbers those of a payload in document order.

    The table is written once and every consumer reads it, so a payload is walked
    once whatever is asked of it.  The walk is over the parsed text, not over a
    VARIANT: that sorts an object's fields by name, and which of two jumps wins
    depends on their order in the text.  A payload that does not parse has no rows.
    """
    names = [c.split()[0] for c in ACTION.split(", ")]
    told = slides.select(*keys, json)
    key_ddl = ", ".join(f"{k} {told.schema[k].dataType.simpleString()}" for k in keys)
    kinds = [{"boolean": pa.bool_(), "int": pa.int32()}.get(c.split()[1], pa.string()) for c in ACTION.split(", ")]

    def rows(batches):
        for batch in batches:
            at, out = [], []
            for i, payload in enumerate(batch.column(len(keys)).to_pylist()):
                found: list = []
                try:
                    _action_rows(loads(payload), "", {"cond": False}, found)
                except (TypeError, ValueError):
                    continue
                at += [i] * len(found)
                out += found
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            told = [pa.array([r.get(n) for r in out], kind) for n, kind in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([*own, *told], [*keys, *names])

    return stored(told.mapInArrow(rows, f"{key_ddl}, {ACTION}"), "actions")


# -- texts, objects, menus --------------------------------------------------------

def _spans(obj: Column) -> Column:
    libs = children(obj, "textLib")
    blocks = F.flatten(F.transform(libs, lambda t: children(t, "vartext.blocks")))
    return F.flatten(F.transform(blocks, lambda b: children(b, "spans")))


def screen_texts(slides: DataFrame) -> DataFrame:
    """Adds ``texts``: trimmed text spans of top-level objects, in order."""
    objs = F.flatten(F.transform(children(F.col("v"), "slideLayers"), lambda la: children(la, "objects")))
    spans = F.flatten(F.transform(objs, _spans))
    return slides.withColumn("texts", F.filter(F.transform(spans, lambda s: F.trim(text_of(s, "text"))), lambda t: t != ""))


def duration_ms(slides: DataFrame) -> DataFrame:
    """Adds ``duration_ms``: the longest layer timeline."""
    each = F.transform(children(F.col("v"), "slideLayers"), lambda la: get(la, "timeline.duration", "double"))
    return slides.withColumn("duration_ms", F.coalesce(F.array_max(each), F.lit(0.0)))


def layers(slides: DataFrame, *keys: str) -> DataFrame:
    return (slides.select(*keys, F.posexplode(children(F.col("v"), "slideLayers")).alias("layer_no", "l"))
            .select(*keys, "layer_no", text_of(F.col("l"), "id").alias("layer_id"),
                    F.coalesce(get(F.col("l"), "isBaseLayer", "boolean"), F.lit(False)).alias("is_base"),
                    text_of(F.col("l"), "presentAs").alias("present_as"),
                    F.coalesce(get(F.col("l"), "modal", "boolean"), F.lit(False)).alias("modal"),
                    text_of(F.col("l"), "labeledById").alias("labeled_by_id"), F.col("l").alias("layer")))


def flatten_objects(slides: DataFrame, *keys: str, json: str = "payload") -> DataFrame:
    """One row per object of any depth, containers before their contents."""
    flat = layers(slides.withColumn("__depth", nesting(F.col(json))), *keys, "__depth")
    rows = flat.select(*keys, "layer_no", "layer_id", "is_base", F.explode(
        walk_field(children(F.col("layer"), "objects"), "objects", F.col("__depth"))).alias("o"))
    o = F.col("o.node")
    spans = _spans(o)
    alts = F.filter(F.transform(children(o, "states"), lambda s: text_of(s, "data.vectorData.altText")), lambda a: a != "")
    text = F.trim(F.array_join(F.filter(F.transform(spans, lambda s: text_of(s, "text")), lambda t: t != ""), " "))
    fonts = F.transform(spans, lambda s: F.coalesce(get(s, "style.fontSize", "double"), get(s, "style.fontsize", "double")))
    click = F.exists(children(o, "events"), lambda e: text_of(e, "kind").isin(*CLICKS))
    return rows.select(
        *keys, "layer_no", "layer_id", "is_base", F.col("o.path").alias("path"), text_of(o, "id").alias("obj_id"),
        text_of(o, "kind").alias("kind"), text_of(o, "accType").alias("acc_type"),
        F.coalesce(get(o, "tabIndex", "int"), F.lit(-1)).alias("tab_index"),
        F.coalesce(get(o, "tabEnabled", "boolean"), F.lit(False)).alias("tab_enabled"),
        text_of(o, "referenceName").alias("reference_name"), text.alias("text"),
        F.coalesce(F.get(alts, F.lit(0)), F.lit("")).alias("alt_text"), click.alias("has_click_event"),
        F.coalesce(F.array_max(fonts), F.lit(0.0)).alias("max_font_size"),
        *[F.coalesce(get(o, f, "double"), F.lit(0.0)).alias(c) for f, c in
          (("xPos", "x_pos"), ("yPos", "y_pos"), ("width", "width"), ("height", "height"))])


def flatten_menu(outlines: DataFrame, *keys: str, json: str = "outline") -> DataFrame:
    """Menu items in display order: (ord path, depth, display, title, slide_id).
    Ids lose the player prefix only, never letters of their own."""
    roots = children(F.try_parse_json(json), "links")
    rows = outlines.select(*keys, F.explode(walk_field(roots, "links", nesting(F.col(json)))).alias("m"))
    m = F.col("m.node")
    raw = F.regexp_replace(text_of(m, "slideid"), r"^_player\.", "")
    return rows.select(*keys, F.col("m.path").alias("path"), (F.size(F.split("m.path", r"\.")) - 1).alias("depth"),
                       F.trim(text_of(m, "displaytext")).alias("display"), F.trim(text_of(m, "slidetitle")).alias("slide_title"),
                       F.when(F.contains(raw, F.lit(".")), F.element_at(F.split(raw, r"\."), -1)).otherwise("").alias("slide_id"),
                       F.size(children(m, "links")).alias("n_children"))


# -- actions ------------------------------------------------------------------------

def external_links(acts: DataFrame, *keys: str) -> DataFrame:
    """Every http address an open-url action goes to, with how often."""
    return (acts.filter((F.col("kind") == "open_url") & F.startswith("url", F.lit("http")))
            .groupBy(*keys, "url").agg(F.count("*").alias("n")))


def _reached(acts: DataFrame, roots: Column, root: list[str], keys: list[str]) -> DataFrame:
    """Actions below the root rows and in the groups they call, directly or
    through other groups, however many calls deep.

    The groups one screen defines come out of one payload, so following calls
    is a fold over its small edge list instead of six joins.
    """
    own = acts.filter(roots & F.col("action_group").isNull())
    inside = acts.filter(F.col("action_group").isNotNull() & (F.col("kind") != "action_group"))
    calls = (own.filter("kind = 'exe_actiongroup'").groupBy(*keys, *root).agg(F.collect_set("id").alias("gids")))
    edges = (inside.filter("kind = 'exe_actiongroup'").groupBy(*keys)
             .agg(F.collect_set(F.struct(F.col("action_group").alias("a"), F.col("id").alias("b"))).alias("edges")))
    joined = calls.join(edges, keys, "left").withColumn(
        "edges", F.coalesce("edges", F.array().cast("array<struct<a:string,b:string>>")))
    # A chain of calls is as long as there are distinct groups to call, no longer.
    bound = F.size(F.array_distinct(F.transform("edges", lambda e: e["b"])))
    every = F.aggregate(F.sequence(F.lit(0), bound), F.col("gids"), lambda acc, _: F.array_union(
        acc, F.transform(F.filter("edges", lambda e: F.array_contains(acc, e["a"])), lambda e: e["b"])))
    through = joined.select(*keys, *root, F.explode(every).alias("action_group"))
    fields = ["kind", "id", "ref", "hide_others"]
    called = through.join(inside.select(*keys, "action_group", *fields), [*keys, "action_group"]).select(
        *keys, *root, *fields)
    return own.select(*keys, *root, *fields).unionByName(called)


def _destinations(acts: DataFrame, roots: Column, root: list[str], keys: list[str], last: bool) -> DataFrame:
    """Where the jumps below the root rows lead (``to``): the last or the first
    jump in document order, a called group standing at the place of its call.

    Where a group leads depends on the groups it calls, so a payload's groups
    are resolved in rounds, as many as it has groups with a jump or a call.
    Groups that only call each other lead nowhere.
    """
    jump = F.when(F.col("kind").isin(*ADVANCES), F.nullif("ref", F.lit("")))
    call = F.when(F.col("kind") == "exe_actiongroup", F.col("id"))
    steps = acts.filter(jump.isNotNull() | call.isNotNull())
    inside = steps.filter(F.col("action_group").isNotNull()).groupBy(*keys, "action_group").agg(F.sort_array(
        F.collect_list(F.struct("pos", jump.alias("to"), call.alias("call"))), asc=not last).alias("items"))
    groups = inside.groupBy(*keys).agg(F.collect_list(F.struct(F.col("action_group").alias("name"), "items")).alias("groups"))

    def leads(known: Column, items: Column) -> Column:
        to = F.transform(items, lambda i: F.coalesce(i["to"], F.try_element_at(known, i["call"])))
        return F.get(F.filter(to, lambda t: t.isNotNull()), F.lit(0))

    def round_(known: Column, _: Column) -> Column:
        named = F.transform("groups", lambda g: F.struct(g["name"].alias("name"), leads(known, g["items"]).alias("to")))
        return F.map_from_entries(F.filter(named, lambda g: g["to"].isNotNull()))

    nothing = F.map_from_entries(F.array().cast("array<struct<name:string,to:string>>"))
    resolved = groups.select(*keys, F.explode(F.aggregate(
        F.sequence(F.lit(1), F.size("groups")), nothing, round_)).alias("call", "__to"))
    own = steps.filter(roots & F.col("action_group").isNull()).select(*keys, *root, "pos", jump.alias("to"), call.alias("call"))
    placed = own.join(resolved, [*keys, "call"], "left").withColumn("to", F.coalesce("to", "__to")).filter("to IS NOT NULL")
    pick = F.max_by if last else F.min_by
    return placed.groupBy(*keys, *root).agg(pick("to", "pos").alias("to"))


def prev_target(slides: DataFrame, acts: DataFrame, screens: DataFrame, *keys: str) -> DataFrame:
    """What the player's Previous button of a screen does, and how many
    base-layer buttons go back in history.

    none, gotoplay (one fixed target that is a screen), history_prev,
    conditional (branching, several or unknown targets) or unresolved.
    """
    group = acts.filter((F.col("action_group") == PREVIOUS_GROUP) & F.startswith("path", F.lit("/actionGroups/")))
    nav = F.col("kind").isin("gotoplay", "history_prev")
    found = group.groupBy(*keys).agg(
        F.count_if(nav).alias("n"), F.bool_or(F.col("kind") == "history_prev").alias("hist"),
        F.bool_or(nav & F.col("cond")).alias("cond"), F.count_distinct(F.when(F.col("kind") == "gotoplay", F.col("ref"))).alias("n_to"),
        F.min(F.when(F.col("kind") == "gotoplay", F.col("ref"))).alias("to"))
    backs = acts.filter((F.col("kind") == "history_prev") & F.col("is_base") & F.col("event").isin(*CLICKS)
                        & F.col("owner_kind").isin("vectorshape", "image", "group"))
    backs = backs.groupBy(*keys).agg(F.count_distinct("owner_path").cast("int").alias("buttons"))
    known = screens.select("course_id", F.col("slide_id").alias("to"), F.lit(True).alias("known")).distinct()
    rows = (slides.select(*keys).join(found, list(keys), "left").join(backs, list(keys), "left")
            .join(known, ["course_id", "to"], "left"))
    fixed = ~F.col("cond") & (F.col("n_to") == 1)
    kind = (F.when(F.col("n").isNull(), "none").when(F.col("n") == 0, "unresolved").when(F.col("hist"), "history_prev")
            .when(fixed & F.col("known"), "gotoplay").otherwise("conditional"))
    named = F.when(fixed & ~F.col("hist") & (F.col("n") > 0), F.col("to"))
    return rows.select(*keys, kind.alias("kind"), F.coalesce(named, F.lit("")).alias("target"),
                       F.coalesce("buttons", F.lit(0)).alias("history_prev_buttons"))


def click_effects(acts: DataFrame, *keys: str) -> DataFrame:
    """What clicking each object does: layers shown and hidden, screen moved to
    (the last jump named), exit, media, visited mark."""
    keys = list(keys)
    on_layer = F.when(F.coalesce("is_base", F.lit(True)), "").otherwise(F.col("layer_id"))
    rows = acts.withColumn("on_layer", on_layer).withColumnRenamed("owner", "obj_id")
    root = ["obj_id", "acc_type", "on_layer"]
    clicked = F.col("event").isin(*CLICKS) & F.startswith("event_path", F.concat("owner_path", F.lit("/events/")))
    r = _reached(rows, clicked, root, keys).filter(~F.col("kind").isin(*CLICKS))
    kind, ref = F.col("kind"), F.nullif("ref", F.lit(""))
    hidden = F.when(kind == "hide_slidelayer", F.when(ref.isNull() | (ref == "_this"), F.coalesce(
        F.nullif("on_layer", F.lit("")), F.lit("_this"))).otherwise(ref))
    found = r.groupBy(*keys, *root).agg(
        F.array_sort(F.collect_set(F.when(kind == "show_slidelayer", ref))).alias("shows_layers"),
        F.array_sort(F.collect_set(hidden)).alias("hides_layers"),
        F.bool_or(kind == "close_player").alias("exits"), F.bool_or(kind.isin(*MEDIA)).alias("is_media"),
        F.bool_or((kind == "exe_actiongroup") & (F.col("id") == VISITED_GROUP)).alias("sets_visited"),
        F.bool_or((kind == "show_slidelayer") & F.col("hide_others")).alias("hide_others"))
    to = _destinations(rows, clicked, root, keys, last=True).withColumnRenamed("to", "advances_to")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*keys, *root]]
    return found.alias("f").join(to.alias("t"), same, "left").select("f.*", "t.advances_to")


def layer_closers(effects: DataFrame, *keys: str) -> DataFrame:
    """Objects that close a layer: they hide it, or sit on it and show another
    layer in its place."""
    by_hide = effects.select(*keys, F.explode("hides_layers").alias("layer_id"), "obj_id")
    by_swap = effects.filter(F.col("hide_others") & (F.col("on_layer") != "")).select(
        *keys, F.col("on_layer").alias("layer_id"), "obj_id")
    return by_hide.unionByName(by_swap).filter("layer_id <> '_this'").distinct()


def passive_effects(slides: DataFrame, acts: DataFrame, *keys: str) -> DataFrame:
    """What a screen does unasked: a jump counts only at the end of the
    timeline and the first one named wins, layers may appear on four passive events."""
    r = _reached(acts, F.col("event").isin(*REVEALING), ["event"], list(keys))
    ref = F.nullif("ref", F.lit(""))
    found = r.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "show_slidelayer", ref))).alias("reveals"))
    to = _destinations(acts, F.col("event") == "ontimelinecomplete", [], list(keys), last=False)
    rows = slides.select(*keys).join(found, list(keys), "left").join(to, list(keys), "left")
    return rows.select(*keys, F.when(F.col("to") != F.col("slide_id"), F.col("to")).alias("auto_advance"),
                       F.coalesce("reveals", F.array().cast("array<string>")).alias("reveals"))


def requirements(acts: DataFrame, effects: DataFrame, continues: DataFrame, *keys: str) -> DataFrame:
    """What holds a screen back, as (kind, target) rows without repeats.

    visited: an object that must have been seen (compares on its visited flag
    or state); reveal: an object that shows a layer holding a way on; answer,
    status and variable: compares of the screen's own navigation gate.
    """
    rows = acts.filter("kind = 'compare'")
    a, b = F.col("value_a"), F.col("value_b")
    seen = F.regexp_extract(a, VISITED, 1)
    state = F.when(b == "visited", F.regexp_extract(a, STATE, 1)).when(b == "Visited", F.regexp_extract(a, STATE, 1)).otherwise("")
    target = F.when((seen != "") & (b == "true"), seen).otherwise(state)
    visited = rows.select(*keys, F.lit("visited").alias("kind"), target.alias("target")).filter("target <> ''")
    gated = rows.filter(F.col("action_group") == F.concat(F.lit(GATE_GROUP), F.col("slide_id")))
    kind = (F.when(F.contains(a, F.lit(".$Answered")), "answer").when(F.contains(a, F.lit(".$Status")), "status").otherwise("variable"))
    on = F.regexp_replace(a, r"\.\$(?:Answered|Status).*$", "")
    gates = gated.select(*keys, kind.alias("kind"), F.when(kind == "variable", a).otherwise(on).alias("target"))
    wanted = continues.filter("on_layer <> ''").select(*keys, F.col("on_layer").alias("layer_id")).distinct()
    reveal = (effects.select(*keys, "obj_id", F.explode("shows_layers").alias("layer_id")).join(wanted, [*keys, "layer_id"], "left_semi")
              .select(*keys, F.lit("reveal").alias("kind"), F.col("obj_id").alias("target")))
    return visited.unionByName(gates).unionByName(reveal).distinct()


def control_edges(effects: DataFrame, screens: DataFrame) -> DataFrame:
    """Moves between screens with their direction; an unknown target is forward."""
    at = screens.select("course_id", "slide_id", "ord")
    moves = effects.filter("advances_to IS NOT NULL").select("course_id", "slide_id", "obj_id", "on_layer", "advances_to")
    here = moves.join(at, ["course_id", "slide_id"], "left").withColumnRenamed("ord", "__from")
    there = at.select("course_id", F.col("slide_id").alias("advances_to"), F.col("ord").alias("__to"))
    rows = here.join(there, ["course_id", "advances_to"], "left")
    back = F.coalesce(F.col("__to") <= F.col("__from"), F.lit(False))
    return rows.select("course_id", "slide_id", "obj_id", "on_layer", "advances_to", F.when(back, "back").otherwise("forward").alias("direction"))


def branches(edges: DataFrame) -> DataFrame:
    """Screens with more than one forward target."""
    ahead = edges.filter("direction = 'forward'").groupBy("course_id", "slide_id", "advances_to").agg(F.count("*").alias("n"))
    return ahead.groupBy("course_id", "slide_id").agg(F.count("*").alias("n_targets")).filter("n_targets > 1")


# -- questions ------------------------------------------------------------------------

def questions(interactions: DataFrame, *keys: str, json: str = "interactions") -> DataFrame:
    """Questions of a JSON array: choices, and the ids its first correct answer
    names that are choices of it."""
    q = F.col("q")
    rows = interactions.select(*keys, F.posexplode(children_of_list(F.try_parse_json(json))).alias("ord", "q"))
    choices = F.transform(children(q, "choices"), lambda c: F.struct(
        text_of(c, "id").alias("id"), F.trim(text_of(c, "lmstext")).alias("text")))
    correct = F.get(F.filter(children(q, "answers"), lambda a: text_of(a, "status") == "correct"), F.lit(0))
    named = F.transform(children(correct, "evaluate.statements"), lambda s: F.replace(text_of(s, "choiceid"), F.lit("choices.")))
    kept = F.filter(named, lambda i: (i != "") & F.exists(choices, lambda c: c["id"] == i))
    return rows.select(*keys, "ord", text_of(q, "id").alias("question_id"), text_of(q, "lmsId").alias("lms_id"),
                       F.trim(text_of(q, "lmstext")).alias("question_text"), F.coalesce(get(q, "type"), F.lit("unknown")).alias("question_type"),
                       F.coalesce(get(q, "issurvey", "boolean"), F.lit(False)).alias("is_survey"), choices.alias("choices"),
                       F.coalesce(kept, F.array().cast("array<string>")).alias("correct_choice_ids"), q.alias("raw"))


def matching_pairs(asked: DataFrame, *keys: str) -> DataFrame:
    """Drag and drop objects of correct answers of matching questions, with their texts."""
    q = F.col("raw")
    answers = F.filter(children(q, "answers"), lambda a: text_of(a, "status") == "correct")
    pairs = F.flatten(F.transform(answers, lambda a: children(a, "evaluate.statements")))
    tail = lambda s, f: F.element_at(F.split(text_of(s, f), r"\."), -1)

    def named(field: str, i: Column) -> Column:
        hit = F.get(F.filter(children(q, field), lambda c: text_of(c, "id") == i), F.lit(0))
        return text_of(hit, "lmstext")

    rows = asked.filter("question_type = 'matching'").select(*keys, "question_id", "raw", F.explode(pairs).alias("p"))
    rows = rows.select(*keys, "question_id", "raw", tail(F.col("p"), "choiceid").alias("c"), tail(F.col("p"), "statementid").alias("s"))
    rows = rows.filter(F.startswith("c", F.lit("choice_")) & F.startswith("s", F.lit("statement_")))
    return rows.select(*keys, "question_id", F.regexp_replace("c", "^choice_", "").alias("drag_obj"),
                       F.regexp_replace("s", "^statement_", "").alias("drop_obj"),
                       named("choices", F.col("c")).alias("drag_text"), named("statements", F.col("s")).alias("drop_text"))


def question_inventory(asked: DataFrame, objects: DataFrame, *keys: str) -> DataFrame:
    """Each choice with the object it is bound to; unbound ones are listed as
    such, never guessed."""
    rows = asked.select(*keys, "question_id", "lms_id", "question_type", "is_survey", "correct_choice_ids", F.explode("choices").alias("c"))
    oid = F.when(F.startswith("c.id", F.lit("choice_")), F.regexp_replace("c.id", "^choice_", "")).otherwise("")
    rows = rows.select(*keys, "question_id", "lms_id", "question_type", "is_survey", F.col("c.id").alias("choice_id"), F.col("c.text").alias("text"),
                       oid.alias("obj_id"), F.array_contains("correct_choice_ids", F.col("c.id")).alias("correct"))
    there = objects.select(*keys, "obj_id").distinct().withColumn("__there", F.lit(True))
    return (rows.join(there, [*keys, "obj_id"], "left")
            .withColumn("bound", F.coalesce("__there", F.lit(False)) & (F.col("obj_id") != "")).drop("__there"))
