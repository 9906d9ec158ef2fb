"""Site audits over page tables and a fetch log, and the run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from .spread import salted_join


def _attribute(html: Column, tag: str, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\s[^>]*?\b{name}\s*=\s*[\"']([^\"']*)[\"']"), 1)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, kind, url): every image that is not inline data, and each
    internal link once, absolute and without a fragment."""
    src = F.filter(F.transform(_attribute(F.col(html), "img", "src"), F.trim),
                   lambda s: (s != "") & ~F.startswith(s, F.lit("data:")))
    href = F.filter(F.transform(_attribute(F.col(html), "a", "href"), F.trim),
                    lambda s: (s != "") & ~s.rlike(r"^(?:#|mailto:|tel:|javascript:)"))
    base = F.col(url)
    images = F.transform(src, lambda s: F.struct(F.lit("image").alias("kind"), W.join_url(base, s).alias("url")))
    absolute = F.array_distinct(F.transform(href, lambda s: F.regexp_replace(W.join_url(base, s), "#.*$", "")))
    links = F.transform(F.filter(absolute, lambda u: W.is_internal(u, base)),
                        lambda u: F.struct(F.lit("link").alias("kind"), u.alias("url")))
    return (pages.select("page_id", F.explode(F.concat(images, links)).alias("r"))
            .select("page_id", "r.kind", "r.url"))


def resource_status(links: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Links with what fetching them gave; never fetched counts as not ok.

    Of several fetches of a URL the newest (``fetched_at``) counts, the higher status among equally new ones.  A link every
    page carries is one hot URL, so the join is salted.
    """
    log = fetch_log.groupBy("url").agg(F.max_by(F.struct("status", "note"), F.struct("fetched_at", "status")).alias("f"))
    joined = salted_join(links, log, ["url"], "left", spread_on=["page_id", "kind"])
    status = F.coalesce("f.status", F.lit(0))
    return joined.select("page_id", "kind", "url", status.alias("status"), W.status_ok(status).alias("ok"),
                         F.when(F.col("f").isNull(), "not fetched").otherwise(
                             F.coalesce("f.note", F.lit(""))).alias("note"))


def page_summary(pages: DataFrame, resources: DataFrame, status: str = "status") -> DataFrame:
    """One row per page with its issues in words; resources of a page that did
    not load are not counted."""
    loaded = W.status_ok(F.col(status))
    broken = (resources.filter(~F.col("ok")).groupBy("page_id")
              .agg(F.count_if(F.col("kind") == "image").alias("__img"),
                   F.count_if(F.col("kind") == "link").alias("__link")))
    rows = pages.select("page_id", F.col(status).alias("__status"), loaded.alias("__ok")).join(broken, "page_id", "left")
    n_img = F.when(F.col("__ok"), F.coalesce("__img", F.lit(0))).otherwise(0)
    n_link = F.when(F.col("__ok"), F.coalesce("__link", F.lit(0))).otherwise(0)
    words = F.concat_ws(", ",
                        F.when(~F.col("__ok"), F.concat(F.lit("page returned HTTP "), F.col("__status").cast("string"))),
                        F.when(n_img > 0, F.concat(n_img.cast("string"), F.lit(" broken image(s)"))),
                        F.when(n_link > 0, F.concat(n_link.cast("string"), F.lit(" dead link(s)"))))
    return rows.select("page_id", n_img.alias("n_broken_images"), n_link.alias("n_dead_links"),
                       F.when(words == "", "OK").otherwise(words).alias("summary"))


def site_summary(summaries: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return summaries.groupBy(*scope).agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("summary") != "OK").alias("n_with_issues"))


def menu_vs_screen(menu: DataFrame, keys: Sequence[str], display: str, title: str) -> DataFrame:
    """Menu labels that differ from their screen's title once entities are decoded."""
    shown, real = F.trim(F.col(display)), F.trim(F.col(title))
    return (menu.filter((shown != "") & (real != "") & (T.unescape_entities(shown) != T.unescape_entities(real)))
            .select(*keys, shown.alias("display"), real.alias("slide_title")))


def menu_without_title(menu: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Menu leaves without a title, counted per scope (``n_children`` per item)."""
    return menu.groupBy(*scope).agg(F.count_if(
        (F.coalesce(F.trim("slide_title"), F.lit("")) == "") & (F.col("n_children") == 0)).alias("n_untitled"))


def update_versions(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    v = W.extract_versions(F.col(text))
    return rows.select(*keys, v["current"].alias("current"), v["available"].alias("available"))


# -- run history --------------------------------------------------------------

def latest_run(runs: DataFrame, scope: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Newest run of each scope.  Newest means the highest id, not the latest
    clock time: clocks are set back, ids are not."""
    newest = runs.groupBy(*scope).agg(F.max_by(F.struct("run_id", *fields), "run_id").alias("__r"))
    return newest.select(*scope, "__r.run_id", *[F.col("__r")[f].alias(f) for f in fields])


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(n)


def next_due(runs: DataFrame, targets: DataFrame, scope: Sequence[str], every: str, now: Column) -> DataFrame:
    """When each target is due again.  ``every`` names its column of days; a
    target never run is due at once."""
    last = runs.groupBy(*scope).agg(F.max_by("ts", "run_id").alias("last_run"))
    rows = targets.join(last, list(scope), "left")
    due = F.col("last_run") + F.make_dt_interval(F.col(every))
    state = (F.when(F.col("last_run").isNull(), "never").when(due <= now, "overdue").otherwise("scheduled"))
    return rows.select(*scope, "last_run", due.alias("due"), state.alias("state"))
