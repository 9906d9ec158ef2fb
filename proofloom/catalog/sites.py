"""Site audits over ``pages``; ``events`` stand in for stored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import table
from .campaigns import events
from ..functions import text as T
from ..functions import web as W
from ..operators import sites as S
from ..sources import files


def pages(spark, sf):
    """Every page gets links of the kinds a crawl meets, before its article."""
    extra = F.concat(F.lit('<img src="data:xyz"><img class="a" src="../img/./'), F.col("page_id").cast("string"),
                     F.lit('.png"><a href="rel/p.html#top">r</a><a class=x href=\'//other.example.com/q\'>o</a>'
                           '<a href="mailto:a@b.c">m</a><a href="?z=1">q</a><article>'))
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", F.replace("html", F.lit("<article>"), extra).alias("html"))


def links(spark, sf):
    return S.page_links(pages(spark, sf))


def fetch_log(spark, sf):
    """Two fetches of every URL: a failure long ago and what it gives now."""
    n = F.length("url")
    now = F.struct(F.lit(2).alias("fetched_at"), F.when(n % 5 == 4, 0).when(n % 5 == 3, 404).otherwise(200).alias("status"),
                   F.when(n % 5 == 4, "timeout").otherwise("").alias("note"))
    past = F.struct(F.lit(1).alias("fetched_at"), F.lit(500).alias("status"), F.lit("down").alias("note"))
    return (links(spark, sf).select("url").distinct().filter(n % 11 != 0)
            .select("url", F.explode(F.array(past, now)).alias("f")).select("url", "f.*"))


def resources(spark, sf):
    return S.resource_status(links(spark, sf), fetch_log(spark, sf))


def q_links(spark, sf):
    return links(spark, sf)


def q_internal(spark, sf):
    p = pages(spark, sf)
    href = F.explode(F.regexp_extract_all("html", F.lit("href=[\"']([^\"']*)[\"']"), 1)).alias("href")
    rows = p.select("page_id", "url", href)
    return (rows.select("page_id", W.is_internal(F.col("href"), F.col("url")).alias("internal"))
            .groupBy("page_id", "internal").agg(F.count("*").alias("n")))


def q_status(spark, sf):
    return resources(spark, sf)


def q_page_summary(spark, sf):
    p = pages(spark, sf).withColumn("status", F.when(F.endswith("url", F.lit(".html")), 500).otherwise(200))
    return S.page_summary(p, resources(spark, sf))


def q_site_summary(spark, sf):
    site = pages(spark, sf).select("page_id", W.site(F.col("url")).alias("site"))
    return S.site_summary(q_page_summary(spark, sf).join(site, "page_id"), ["site"])


def _menu(spark, sf):
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    h1 = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    return table(spark, sf, "pages").select(
        "page_id", "url", title.alias("display"),
        F.when(F.endswith("url", F.lit("/")), "").otherwise(F.concat(
            T.strip_html(h1), F.when(F.startswith("url", F.lit("http:")), "!").otherwise(""))).alias("slide_title"), F.lit(0).alias("n_children"))


def q_menu(spark, sf):
    return S.menu_vs_screen(_menu(spark, sf), ["page_id"], "display", "slide_title")


def q_menu_untitled(spark, sf):
    m = _menu(spark, sf).withColumn("site", W.site(F.col("url")))
    return S.menu_without_title(m, ["site"])


def q_strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.strip_html(F.col("html")).cast("binary")).alias("digest"),
                                            F.length(T.strip_html(F.col("html"))).alias("n_chars"))


def q_versions(spark, sf):
    p = table(spark, sf, "part")
    v1 = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("3"))
    v2 = F.concat(v1, F.lit(".1"))
    row = (F.when(F.col("p_size") > 30, F.concat(F.lit("You have version "), v1, F.lit(" installed. Update to "), v2, F.lit(".")))
           .when(F.col("p_size") > 20, F.concat(F.lit("Plugin "), v1, F.lit(" => "), v2))
           .when(F.col("p_size") > 10, F.concat(F.lit("Theme "), v2)).otherwise(F.lit("none listed")))
    return S.update_versions(p.select("p_partkey", row.alias("text")), ["p_partkey"], "text")


def q_core_version(spark, sf):
    s = table(spark, sf, "supplier")
    v = F.concat(F.lit("6."), F.col("s_nationkey").cast("string"))
    row = (F.when(F.col("s_acctbal") > 6000, F.concat(F.lit("An updated version of WordPress "), v,
                                                      F.lit(" is available. You are using WordPress 5.9.1")))
           .when(F.col("s_acctbal") > 2000, F.concat(F.lit("WordPress "), v, F.lit(" is available; current version: 5.8")))
           .otherwise(F.lit("You have the latest version of WordPress. current version: 5.8")))
    c = W.core_version(row)
    return s.select("s_suppkey", c["current"].alias("current"), c["available"].alias("available"))


def _runs(spark, sf):
    return events(spark, sf).select(F.col("event_id").alias("run_id"), "ts", F.col("event_type").alias("kind"),
                                    F.col("user_id").alias("target"), F.col("props").alias("payload"))


def q_latest(spark, sf):
    return S.latest_run(_runs(spark, sf), ["target", "kind"], ["payload"])


def q_recent(spark, sf):
    return S.recent_runs(_runs(spark, sf), 25).select("run_id", "kind", "target", "payload")


def q_due(spark, sf):
    runs = _runs(spark, sf)
    targets = (table(spark, sf, "customer").select(F.col("c_custkey").alias("target"), (F.col("c_nationkey") % 20).alias("every")))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    d = S.next_due(runs, targets, ["target"], "every", now)
    return d.select("target", "state", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


def q_run_records(spark, sf):
    """Runs stored as JSON and typed again."""
    e = events(spark, sf).select("event_id", "user_id", "event_type")
    r = files.run_records(e, F.col("event_id"), F.lit("2024-01-01").cast("timestamp"), "site", F.col("event_type") == "error")
    back = r.withColumn("p", F.from_json("payload", "event_id bigint, user_id bigint, event_type string"))
    return back.select("run_id", "kind", "has_issues", "p.user_id", "p.event_type")


def q_marker_lines(spark, sf):
    """Events written as marker and transcript lines and read back."""
    e = events(spark, sf)
    ms = F.unix_millis("ts").cast("string")
    line = (F.when(F.col("event_type") == "view", F.concat(F.date_format("ts", "HH:mm:ss.SSS "), ms, F.lit(" | SCREEN s"), F.col("user_id").cast("string")))
            .when(F.col("event_type") == "click", F.concat(ms, F.lit(" | said | "), F.col("props"))).otherwise(F.lit("noise")))
    out = files.parse_marker_lines(e.select("event_id", line.alias("value")))
    return out.select("event_id", F.unix_millis("ts").alias("ms"), "text")


def q_projection(spark, sf):
    return files.projection(table(spark, sf, "nation"), ["N_NAME", "missing", "n_regionkey"])


QUERIES = {
    "page_links": q_links, "internal_links": q_internal, "resource_status": q_status, "page_summary": q_page_summary,
    "site_summary": q_site_summary, "menu_vs_screen": q_menu, "menu_without_title": q_menu_untitled, "strip_html": q_strip_html,
    "update_versions": q_versions, "core_version": q_core_version, "latest_run": q_latest, "recent_runs": q_recent,
    "next_due": q_due, "run_records": q_run_records, "marker_lines": q_marker_lines, "projection_columns": q_projection,
}

_LINKS = """pg AS (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  pf AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM pg),
  pr AS (SELECT *, CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END AS parent FROM pf),
  links AS (SELECT page_id, 'image' AS kind, root || parent || 'img/' || page_id || '.png' AS url FROM pr
    UNION ALL SELECT DISTINCT page_id, 'link', root || regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '#.*', '') FROM pr
    UNION ALL SELECT page_id, 'link', root || folder || 'rel/p.html' FROM pr
    UNION ALL SELECT page_id, 'link', root || path || '?z=1' FROM pr)"""
_RES = _LINKS + """, resources AS (SELECT page_id, kind, url, CASE WHEN length(url) % 11 = 0 OR length(url) % 5 = 4 THEN 0 WHEN length(url) % 5 = 3 THEN 404 ELSE 200 END AS status,
    length(url) % 11 <> 0 AND length(url) % 5 < 3 AS ok, CASE WHEN length(url) % 11 = 0 THEN 'not fetched' WHEN length(url) % 5 = 4 THEN 'timeout' ELSE '' END AS note FROM links)"""
_SUMM = _RES + """, pb AS (SELECT page_id, host, ends_with(url, '.html') AS bad FROM pg), sm AS (SELECT p.page_id, p.host, bad, CASE WHEN bad THEN 0 ELSE count(*) FILTER (kind = 'image' AND NOT ok) END AS n_broken_images,
    CASE WHEN bad THEN 0 ELSE count(*) FILTER (kind = 'link' AND NOT ok) END AS n_dead_links FROM pb p LEFT JOIN resources r ON r.page_id = p.page_id GROUP BY p.page_id, p.host, bad),
  summ AS (SELECT page_id, host, n_broken_images, n_dead_links, CASE WHEN bad THEN 'page returned HTTP 500' ELSE CASE WHEN n_broken_images + n_dead_links = 0 THEN 'OK' ELSE
    concat_ws(', ', CASE WHEN n_broken_images > 0 THEN n_broken_images || ' broken image(s)' END, CASE WHEN n_dead_links > 0 THEN n_dead_links || ' dead link(s)' END) END END AS summary FROM sm)"""


def _unescaped(c: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&quot;", '"')):
        c = f"replace({c}, '{a}', '{b}')"
    return f"replace(replace({c}, '&nbsp;', chr(160)), '&amp;', '&')"


def _stripped(c: str) -> str:
    c = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "''"), ("&quot;", '"')):
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim({c})"


_MENU = """m AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS display, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS site,
    CASE WHEN ends_with(url, '/') THEN '' ELSE """ + _stripped("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + """ || CASE WHEN starts_with(url, 'http:') THEN '!' ELSE '' END END AS slide_title FROM pages)"""
ORACLE = {
    "page_links": f"WITH {_LINKS} SELECT * FROM links",
    "internal_links": f"""WITH {_LINKS}, h AS (SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pg) GROUP BY page_id)
      SELECT p.page_id, true AS internal, coalesce(n, 0) + 2 AS n FROM pg p LEFT JOIN h USING (page_id) UNION ALL SELECT page_id, false, 1 FROM pg WHERE false
      UNION ALL SELECT page_id, false, 1 FROM pg""".replace("coalesce(n, 0) + 2", "coalesce(n, 0) + 3"),
    "resource_status": f"WITH {_RES} SELECT * FROM resources",
    "page_summary": f"WITH {_SUMM} SELECT page_id, n_broken_images, n_dead_links, summary FROM summ",
    "site_summary": f"""WITH {_SUMM} SELECT regexp_replace(host, '^www\\.', '') AS site, count(*) AS n_pages, count(*) FILTER (summary <> 'OK') AS n_with_issues FROM summ GROUP BY 1""",
    "menu_vs_screen": f"WITH {_MENU} SELECT page_id, trim(display) AS display, slide_title FROM m WHERE trim(display) <> '' AND slide_title <> '' AND {_unescaped('trim(display)')} <> {_unescaped('slide_title')}",
    "menu_without_title": f"WITH {_MENU} SELECT site, count(*) FILTER (slide_title = '') AS n_untitled FROM m GROUP BY site",
    "strip_html": f"SELECT page_id, md5({_stripped('html')}) AS digest, length({_stripped('html')})::INT AS n_chars FROM pages",
    "update_versions": """WITH v AS (SELECT p_partkey, p_size, p_size || '.' || (p_partkey % 10) || '.3' AS v1 FROM part)
      SELECT p_partkey, CASE WHEN p_size > 20 THEN v1 ELSE '' END AS current, CASE WHEN p_size > 10 THEN v1 || '.1' ELSE '' END AS available FROM v""",
    "core_version": """SELECT s_suppkey, CASE WHEN s_acctbal > 6000 THEN '5.9.1' WHEN s_acctbal > 2000 THEN '5.8' ELSE '' END AS current,
      CASE WHEN s_acctbal > 2000 THEN '6.' || s_nationkey ELSE '' END AS available FROM supplier""",
    "latest_run": "SELECT user_id AS target, event_type AS kind, max(event_id) AS run_id, arg_max(props, event_id) AS payload FROM events GROUP BY 1, 2",
    "recent_runs": "SELECT event_id AS run_id, event_type AS kind, user_id AS target, props AS payload FROM events ORDER BY event_id DESC LIMIT 25",
    "next_due": """WITH l AS (SELECT user_id, arg_max(ts, event_id) AS ts FROM events GROUP BY 1),
      d AS (SELECT c_custkey AS target, ts, ts + to_days((c_nationkey % 20)::INT) AS due FROM customer LEFT JOIN l ON user_id = c_custkey)
      SELECT target, CASE WHEN ts IS NULL THEN 'never' WHEN due <= TIMESTAMP '2024-01-31' THEN 'overdue' ELSE 'scheduled' END AS state, strftime(due, '%Y-%m-%d %H:%M:%S') AS due FROM d""",
    "run_records": "SELECT event_id AS run_id, 'site' AS kind, event_type = 'error' AS has_issues, user_id, event_type FROM events",
    "marker_lines": """SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type = 'view' THEN 's' || user_id ELSE 'said | ' || props END AS text FROM events WHERE event_type IN ('view', 'click')""",
    "projection_columns": "SELECT n_name AS \"N_NAME\", '' AS missing, n_regionkey::VARCHAR AS n_regionkey FROM nation",
}
