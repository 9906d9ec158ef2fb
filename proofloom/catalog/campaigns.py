"""Campaign reports over ``events``: every day is a campaign, a user's events of
the day fill the export's columns by event type and value."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import table
from ..operators import campaign as K

DAY_ONE = "2024-01-01"


def events(spark, sf):
    return (table(spark, sf, "events")
            .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props"))


def exports(spark, sf):
    """One export row per user and day; ``day`` counts from the first of January."""
    e = events(spark, sf).withColumn("day", F.datediff("ts", F.lit(DAY_ONE)))

    def when(cond):
        at = F.date_format(F.min(F.when(cond, F.col("ts"))), "yyyy-MM-dd HH:mm:ss")
        return F.coalesce(at, F.lit("--"))

    t, v = F.col("event_type"), F.col("value")
    return (e.groupBy("day", "user_id").agg(
        F.when(F.count_if((t == "purchase") & (v > 40)) > 0, "Yes").otherwise("No").alias(K.COMPROMISED),
        when((t == "click") & (v > 10)).alias("EmailLinkClicked_TimeStamp(Compromised)"),
        when((t == "purchase") & (v > 20)).alias("CredSupplied_TimeStamp(Compromised)"),
        when((t == "view") & (v > 45)).alias("QrScanned_TimeStamp"),
        when((t == "error") & (v > 20)).alias(K.DELIVERY_FAILED_AT),
        when((t == "signup") & (v > 25)).alias(K.REPLIED_AT),
        when(t == "signup").alias(K.FORWARDED_AT),
        when(t == "view").alias(K.REPORTED_AT),
        when(t == "error").alias(K.DELETED_AT))
        .withColumn(K.NAME, F.concat(F.lit("User "), F.col("user_id").cast("string")))
        .withColumn(K.MAIL, F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@example.com"))))


def classified(spark, sf):
    return K.classify_outcome(exports(spark, sf))


def q_outcome(spark, sf):
    return K.failure_reason(classified(spark, sf)).select("day", K.MAIL, "sheet", "reason")


def q_outcome_answered(spark, sf):
    return (K.classify_outcome(exports(spark, sf), {"QrScanned_TimeStamp": False})
            .groupBy("day", "sheet").agg(F.count("*").alias("n_users")))


def q_counts(spark, sf):
    return K.outcome_counts(classified(spark, sf), ["day"])


def q_summary(spark, sf):
    return K.campaign_summary(classified(spark, sf), ["day"])


def q_summary_lines(spark, sf):
    return K.summary_lines(q_summary(spark, sf), ["day"], exports(spark, sf).columns)


def q_unknown_usage(spark, sf):
    return K.unknown_column_usage(exports(spark, sf))


def q_streaks(spark, sf):
    return K.campaign_streaks(classified(spark, sf), "day")


def q_histogram(spark, sf):
    return K.streak_histogram(q_streaks(spark, sf), ["day"], "streak")


def _sheets(spark, sf):
    """Every day's workbook after the split of its fail sheet."""
    c = classified(spark, sf)
    s = q_streaks(spark, sf).select(F.col("mail").alias("__mail"), "day", "streak")
    joined = c.withColumn("__mail", F.lower(K.MAIL)).join(s, ["__mail", "day"], "left")
    return joined.withColumn("sheet", F.when(F.col("streak").isNotNull(), F.concat(
        F.lit("Fail x "), F.col("streak").cast("string"))).otherwise(F.col("sheet"))).drop("__mail", "streak")


def q_history(spark, sf):
    return K.history_streaks(_sheets(spark, sf).select("day", "sheet", K.MAIL), ["day"])


def q_history_plain(spark, sf):
    return K.history_streaks(classified(spark, sf).select("sheet", K.MAIL))


def q_history_warnings(spark, sf):
    return K.history_warnings(classified(spark, sf).select("sheet", K.MAIL))


def q_streak_update(spark, sf):
    """Each day's failures against the workbook of the day before."""
    before = q_history(spark, sf).withColumn("day", F.col("day") + 1)
    fails = classified(spark, sf).filter(F.col("sheet") == K.FAIL).select("day", K.MAIL)
    return K.streak_update(fails, before, ["day"])


def q_apply_decisions(spark, sf):
    """Users with an even id forwarded to the approved mailbox."""
    c = classified(spark, sf)
    ruling = exports(spark, sf).select(F.col(K.MAIL).alias("mail"), (F.col("user_id") % 2 == 0).alias("approved"))
    return (K.apply_decisions(c, ruling.distinct()).groupBy("day", "sheet", K.COMPROMISED)
            .agg(F.count("*").alias("n_users")))


def q_mailing_lists(spark, sf):
    return K.mailing_lists(_sheets(spark, sf), "user_id", "Extra@example.com", ["day"])


def _answers(spark, sf):
    """Reviewer's table: every event is a row of four cells."""
    e = events(spark, sf).filter(F.col("event_type").isin("signup", "view"))
    mail = F.concat(F.lit("USER"), F.col("user_id").cast("string"), F.lit("@Example.com"))
    word = (F.when(F.col("value") > 30, "Yes.").when(F.col("value") > 15, "did not report")
            .when(F.col("value") > 8, "No").otherwise("--"))
    cells = F.array(F.struct(F.lit(0).alias("col_no"), F.lit("note").alias("value")),
                    F.struct(F.lit(1).alias("col_no"), F.concat(F.lit("<"), mail, F.lit(">")).alias("value")),
                    F.struct(F.lit(2).alias("col_no"), word.alias("value")),
                    F.struct(F.lit(3).alias("col_no"), F.lit("2024-01-01").alias("value")))
    return e.select(F.lit("reply.csv").alias("source"), (F.col("event_id") + 10).alias("row_no"),
                    F.explode(cells).alias("c")).select("source", "row_no", "c.*")


def _forwarders(spark, sf):
    return (classified(spark, sf).filter(F.col("sheet") == K.FORWARDS)
            .select(F.col(K.MAIL).alias("mail")).distinct())


def q_review_rows(spark, sf):
    return K.parse_review_rows(_answers(spark, sf), _forwarders(spark, sf), None)


def q_review_lines(spark, sf):
    e = events(spark, sf).filter("event_type = 'signup'")
    word = (F.when(F.col("value") > 30, "yes, it was reported").when(F.col("value") > 15, "he didn't report it")
            .when(F.col("value") > 8, "y").otherwise("j no"))
    text = e.select(F.col("event_id").alias("line_no"), F.concat(
        F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com "), word).alias("line"))
    return K.parse_review_lines(text, _forwarders(spark, sf), True)


def q_typed_cells(spark, sf):
    """Export cells and order fields written in the formats an export may use."""
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    cell = F.element_at(F.array(
        F.date_format(d, "M/d/yyyy h:mm:ss a"), F.date_format(d, "M/d/yyyy H:mm"),
        F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'.123Z'"), F.date_format(d, "yyyy-MM-dd HH:mm:ss"),
        F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.lit("--"), F.lit(" "))
        , (F.col("o_orderkey") % 8 + 1).cast("int"))
    t = K.typed_cell(cell)
    return o.select("o_orderkey", t["as_int"].alias("as_int"), t["as_time"].cast("string").alias("as_time"),
                    t["as_text"].alias("as_text"))


QUERIES = {
    "campaign_outcome": q_outcome,
    "campaign_outcome_answered": q_outcome_answered,
    "campaign_outcome_counts": q_counts,
    "campaign_summary": q_summary,
    "campaign_summary_lines": q_summary_lines,
    "campaign_unknown_column_usage": q_unknown_usage,
    "campaign_streaks": q_streaks,
    "campaign_streak_histogram": q_histogram,
    "campaign_history_streaks": q_history,
    "campaign_history_plain_fail": q_history_plain,
    "campaign_history_warnings": q_history_warnings,
    "campaign_streak_update": q_streak_update,
    "campaign_apply_decisions": q_apply_decisions,
    "campaign_mailing_lists": q_mailing_lists,
    "campaign_review_rows": q_review_rows,
    "campaign_review_lines": q_review_lines,
    "campaign_typed_cells": q_typed_cells,
}


def _at(cond: str) -> str:
    return f"coalesce(strftime(min(CASE WHEN {cond} THEN ts END), '%Y-%m-%d %H:%M:%S'), '--')"


_EXPORTS = f"""exports AS (SELECT date_diff('day', DATE '{DAY_ONE}', ts::DATE)::INT AS day, user_id,
  CASE WHEN count(*) FILTER (event_type = 'purchase' AND value > 40) > 0 THEN 'Yes' ELSE 'No' END AS compromised,
  {_at("event_type = 'click' AND value > 10")} AS clicked, {_at("event_type = 'purchase' AND value > 20")} AS creds,
  {_at("event_type = 'view' AND value > 45")} AS qr, {_at("event_type = 'error' AND value > 20")} AS undelivered,
  {_at("event_type = 'signup' AND value > 25")} AS replied, {_at("event_type = 'signup'")} AS forwarded,
  {_at("event_type = 'view'")} AS reported, {_at("event_type = 'error'")} AS deleted,
  'User' || user_id || '@example.com' AS mail FROM events GROUP BY 1, 2)"""


def _class(qr: str = "OR qr <> '--'") -> str:
    return _EXPORTS + f""", acted AS (SELECT *, compromised = 'Yes' OR clicked <> '--' OR creds <> '--' {qr} AS acted FROM exports),
  c AS (SELECT *, CASE WHEN undelivered <> '--' THEN 'Delivery Failed' WHEN acted OR replied <> '--' THEN 'Fail'
    WHEN forwarded <> '--' THEN 'forwards' WHEN reported <> '--' THEN 'Pass - Report' WHEN deleted <> '--' THEN 'Pass - Delete'
    ELSE 'Pass - Ignore' END AS sheet,
    CASE WHEN creds <> '--' THEN 'Creds Supplied' WHEN acted THEN 'Click' WHEN replied <> '--' THEN 'Reply'
    WHEN forwarded <> '--' THEN 'Forward' ELSE 'Other' END AS reason FROM acted)"""


_SHEETS = """sheets(i, sheet) AS (VALUES (0, 'Pass - Report'), (1, 'Pass - Delete'), (2, 'Pass - Ignore'),
  (3, 'forwards'), (4, 'Fail'), (5, 'Delivery Failed'))"""
_STREAKS = _class() + """, br AS (SELECT lower(mail) AS mail, day, sheet, CASE WHEN sheet <> 'Fail'
    OR day - lag(day) OVER (PARTITION BY mail ORDER BY day) <> 1 THEN 1 ELSE 0 END AS b FROM c),
  isl AS (SELECT *, sum(b) OVER (PARTITION BY mail ORDER BY day) AS g FROM br),
  streaks AS (SELECT mail, day, sum(CASE WHEN sheet = 'Fail' THEN 1 ELSE 0 END) OVER (PARTITION BY mail, g ORDER BY day)::BIGINT AS streak, sheet FROM isl)"""
_SPLIT = _STREAKS + """, split AS (SELECT c.day, c.user_id, c.mail, CASE WHEN c.sheet = 'Fail' THEN 'Fail x ' || streak ELSE c.sheet END AS sheet,
    CASE WHEN c.sheet = 'Fail' THEN streak WHEN starts_with(c.sheet, 'Pass') THEN 0 WHEN c.sheet = 'Delivery Failed' THEN -1 END::INT AS n
    FROM c JOIN streaks s ON s.mail = lower(c.mail) AND s.day = c.day)"""
_PCT = "CASE WHEN {w} = 0 THEN 0 ELSE floor(({p} * 200 + {w}) / (2 * {w})) END::INT"
_SUMMARY = _class() + """, s AS (SELECT day, count(*) FILTER (sheet = 'Pass - Report') AS n_report,
  count(*) FILTER (sheet = 'Pass - Delete') AS n_delete, count(*) FILTER (sheet = 'Pass - Ignore') AS n_ignore,
  count(*) FILTER (sheet = 'Fail' AND reason = 'Reply') AS n_reply, count(*) FILTER (sheet = 'Fail' AND reason = 'Forward') AS n_forward,
  count(*) FILTER (sheet = 'Fail' AND reason IN ('Click', 'Creds Supplied')) AS n_click,
  count(*) FILTER (sheet = 'Fail' AND reason = 'Creds Supplied') AS n_creds, count(*) FILTER (sheet = 'Fail' AND reason = 'Other') AS n_other,
  count(*) FILTER (sheet = 'forwards') AS n_pending, count(*) FILTER (sheet = 'Delivery Failed') AS n_undelivered FROM c GROUP BY day),
  t AS (SELECT *, n_report + n_delete + n_ignore AS n_passed, n_reply + n_forward + n_click + n_other AS n_failed FROM s),
  u AS (SELECT *, n_passed + n_failed + n_pending AS n_sent FROM t),
  summary AS (SELECT *, """ + _PCT.format(p="n_passed", w="n_sent") + " AS pct_passed, " + _PCT.format(
    p="n_report", w="n_sent") + " AS pct_report, " + _PCT.format(p="n_failed", w="n_sent") + " AS pct_failed FROM u)"
_REPLIES = _class() + """, fw AS (SELECT DISTINCT lower(mail) AS mail FROM c WHERE sheet = 'forwards'),
  a AS (SELECT 'user' || user_id || '@example.com' AS mail, event_id, CASE WHEN value > 30 THEN {a} WHEN value > 15 THEN false
    WHEN value > 8 THEN {b} ELSE {c} END AS ok FROM events WHERE event_type IN ({types})),
  k AS (SELECT mail, arg_max(ok, CASE WHEN ok IS NOT NULL THEN event_id END) AS approved FROM a WHERE mail IN (SELECT mail FROM fw) GROUP BY mail)
  SELECT CASE WHEN approved IS NULL THEN 'ambiguous' ELSE 'decision' END AS kind, mail, approved FROM k
  UNION ALL SELECT DISTINCT 'unknown', mail, NULL::BOOLEAN FROM a WHERE mail NOT IN (SELECT mail FROM fw)"""

ORACLE = {
    "campaign_outcome": f"WITH {_class()} SELECT day, mail AS \"UserMail\", sheet, reason FROM c",
    "campaign_outcome_answered": f"WITH {_class('')} SELECT day, sheet, count(*) AS n_users FROM c GROUP BY ALL",
    "campaign_outcome_counts": f"""WITH {_class()}, {_SHEETS} SELECT d.day, i AS sheet_ord, s.sheet, count(c.mail) AS n_users
      FROM (SELECT DISTINCT day FROM c) d CROSS JOIN sheets s LEFT JOIN c ON c.day = d.day AND c.sheet = s.sheet GROUP BY ALL""",
    "campaign_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
    "campaign_summary_lines": f"""WITH {_SUMMARY}, l AS (SELECT day, list_filter([
      'Total Emails Sent: ' || n_sent, chr(9) || 'Passed: ' || n_passed || ' (' || pct_passed || '%)',
      chr(9) || chr(9) || 'Report: ' || n_report || ' (' || pct_report || '%)', chr(9) || chr(9) || 'Delete: ' || n_delete,
      chr(9) || chr(9) || 'Ignore: ' || n_ignore, chr(9) || 'Fail: ' || n_failed || ' (' || pct_failed || '%)',
      chr(9) || chr(9) || 'Reply: ' || n_reply, chr(9) || chr(9) || 'Forward: ' || n_forward, chr(9) || chr(9) || 'Click: ' || n_click,
      chr(9) || chr(9) || chr(9) || 'Click-Only: ' || (n_click - n_creds), chr(9) || chr(9) || chr(9) || 'Creds Supplied: ' || n_creds,
      CASE WHEN n_other > 0 THEN chr(9) || chr(9) || 'Other: ' || n_other END], lambda x: x IS NOT NULL) AS ls FROM summary)
      SELECT day, unnest(ls) AS line, generate_subscripts(ls, 1)::INT - 1 AS line_no FROM l""",
    "campaign_unknown_column_usage": f"WITH {_EXPORTS} SELECT 'QrScanned_TimeStamp' AS \"column\", count(*) FILTER (qr <> '--') AS n_users FROM exports",
    "campaign_streaks": f"WITH {_STREAKS} SELECT mail, day, streak FROM streaks WHERE sheet = 'Fail'",
    "campaign_streak_histogram": f"""WITH {_STREAKS}, k AS (SELECT day, streak, count(*) AS n FROM streaks WHERE sheet = 'Fail' GROUP BY ALL),
      f AS (SELECT day, unnest(range(1, max(streak) + 1))::INT AS streak FROM k GROUP BY day)
      SELECT f.day, 'Fail x ' || f.streak AS sheet, f.streak, coalesce(n, 0) AS n_users FROM f LEFT JOIN k ON k.day = f.day AND k.streak = f.streak""",
    "campaign_history_streaks": f"WITH {_SPLIT} SELECT day, lower(mail) AS mail, n AS streak FROM split WHERE n IS NOT NULL",
    "campaign_history_plain_fail": f"""WITH {_class()} SELECT lower(mail) AS mail, max(CASE WHEN sheet = 'Fail' THEN 1
      WHEN starts_with(sheet, 'Pass') THEN 0 WHEN sheet = 'Delivery Failed' THEN -1 END)::INT AS streak FROM c GROUP BY 1 HAVING streak IS NOT NULL""",
    "campaign_history_warnings": f"""WITH {_class()} SELECT sheet, count(*) AS n_rows, CASE WHEN sheet = 'Fail' THEN 'plain_fail_as_1'
      ELSE 'ignored_sheet' END AS kind FROM c WHERE sheet IN ('Fail', 'forwards') GROUP BY sheet""",
    "campaign_streak_update": f"""WITH {_SPLIT} SELECT f.day, f.mail AS "UserMail", CASE WHEN coalesce(p.n, 0) < 0 THEN 1 ELSE coalesce(p.n, 0) + 1 END::INT AS new_streak,
      coalesce(p.n, 0) < 0 AS look_back, false AS no_mail, 'Fail x ' || CASE WHEN coalesce(p.n, 0) < 0 THEN 1 ELSE coalesce(p.n, 0) + 1 END AS sheet
      FROM c f LEFT JOIN split p ON p.mail = f.mail AND p.day + 1 = f.day WHERE f.sheet = 'Fail'""",
    "campaign_apply_decisions": f"""WITH {_class()} SELECT day, CASE WHEN sheet <> 'forwards' THEN sheet WHEN user_id % 2 = 0 THEN 'Pass - Report' ELSE 'Fail' END AS sheet,
      CASE WHEN sheet <> 'forwards' THEN compromised WHEN user_id % 2 = 0 THEN 'forward to spam' ELSE 'forward to not spam' END AS "Compromised",
      count(*) AS n_users FROM c GROUP BY ALL""",
    "campaign_mailing_lists": f"""WITH {_SPLIT}, m(list, i, sheet, x) AS (VALUES ('Pass - Report', 0, 'Pass - Report', 0), ('Pass - Not Report', 0, 'Pass - Delete', 1),
      ('Pass - Not Report', 1, 'Pass - Ignore', 1), ('Fail x 1', 0, 'Fail x 1', 1), ('Fail x 2', 0, 'Fail x 2', 1))
      SELECT day, list, mail, i AS sheet_ord, user_id FROM split JOIN m USING (sheet)
      UNION ALL SELECT day, list, 'Extra@example.com', 99, NULL FROM (SELECT DISTINCT day FROM split), (SELECT DISTINCT list FROM m WHERE x = 1)""",
    "campaign_review_rows": "WITH " + _REPLIES.format(a="true", b="false", c="NULL", types="'signup', 'view'"),
    "campaign_review_lines": "WITH " + _REPLIES.format(a="true", b="true", c="false", types="'signup'"),
    "campaign_typed_cells": """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 4 THEN o_orderkey END AS as_int,
      CASE WHEN o_orderkey % 8 < 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS as_time,
      CASE o_orderkey % 8 WHEN 5 THEN o_orderpriority WHEN 6 THEN '--' END AS as_text FROM orders""",
}
