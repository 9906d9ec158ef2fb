"""Session logs over ``events`` (a user is a session) and recorded runs over
``conversations`` (a conversation is a run, a turn a question)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import table
from .campaigns import events
from ..operators import runs as R
from ..operators import sessions as S


def polls(spark, sf):
    """Every event is a poll: its type the screen, the tens of its value the text."""
    e = events(spark, sf)
    return e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"),
                    F.when(F.col("value") < 20, "home").otherwise(F.col("event_type")).alias("slide_id"),
                    F.floor(F.col("value") / 8).cast("string").alias("text_signature"), (F.col("value") > 60).alias("manual"))


def q_changes(spark, sf):
    return S.screen_changes(polls(spark, sf)).select("session_id", "seq", "slide_id")


def q_settle(spark, sf):
    """Polls are hours apart here, so the bounds are given in hours."""
    hour = 3600 * 1000
    return S.settle_detect(polls(spark, sf), min_ms=hour, hold_ms=3 * hour, max_ms=30 * hour).select(
        "session_id", "visit", "slide_id", "seq", "outcome")


def q_utterances(spark, sf):
    e = events(spark, sf)
    base = e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), "event_type", F.col("props").alias("text"),
                    F.col("value").cast("string").alias("slide_id"))
    said = base.filter("event_type = 'click'")
    shown = base.filter("event_type = 'view'")
    return S.utterance_to_screen(said, shown).select("session_id", "seq", "text", "slide_id")


def _calls(spark, sf):
    e = events(spark, sf)
    t = F.col("event_type")
    fn = F.when(t == "purchase", "Commit").when(t == "error", "GetValue").otherwise("SetValue")
    key = F.when(t == "signup", F.concat(F.lit("cmi.interactions."), (F.col("event_id") % 7).cast("string"), F.lit(".id"))).otherwise(
        F.concat(F.lit("cmi."), t))
    return e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), fn.alias("fn"),
                    F.array(key, F.col("props")).alias("args"))


def q_api_state(spark, sf):
    return S.api_state(_calls(spark, sf))


def q_api_totals(spark, sf):
    return S.api_totals(_calls(spark, sf))


def _turns(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))
    key = F.concat(F.lit("L"), F.lpad(F.col("turn").cast("string"), 3, "0"))
    return c.select(F.col("conv_id").alias("run_id"), F.col("conv_id").alias("course_id"), "turn", "text", "role", F.length("text").alias("n"), key.alias("lms_id"))


def _state(spark, sf):
    t = _turns(spark, sf)
    at = F.concat(F.lit("cmi.interactions."), F.col("turn").cast("string"), F.lit("."))
    pairs = F.array_compact(F.array(
        F.struct(F.concat(at, F.lit("id")).alias("key"), F.concat(F.lit("Scene_"), F.when(F.col("n") % 7 == 0, "other").otherwise(F.col("lms_id")),
                                                                  F.lit("_1")).alias("value")),
        F.struct(F.concat(at, F.lit("result")).alias("key"), F.when(F.col("n") % 3 == 0, "incorrect").otherwise("correct").alias("value")),
        F.struct(F.concat(at, F.lit("learner_response")).alias("key"), F.regexp_replace(F.lower("text"), " ", "_").alias("value")),
        F.when(F.col("turn") == 0, F.struct(F.lit("cmi.completion_status").alias("key"), F.when(F.col("n") % 2 == 0, "completed").otherwise("incomplete").alias("value"))),
        F.when(F.col("turn") == 1, F.struct(F.lit("cmi.score.scaled").alias("key"), F.when(F.col("n") % 5 == 0, "none").otherwise(
            (F.col("n") % 100 / 100).cast("string")).alias("value")))))
    return t.select("run_id", F.explode(pairs).alias("p")).select("run_id", "p.key", "p.value")


def _records(spark, sf):
    return R.interactions_from_state(_state(spark, sf))


def q_interactions(spark, sf):
    return _records(spark, sf).select("run_id", "n", "record_id", "result", F.md5(F.col("learner_response").cast("binary")).alias("digest"))


def _matched(spark, sf):
    plan = _turns(spark, sf).select("run_id", F.col("turn").alias("ord"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("interaction_id"), "lms_id",
                                    F.lit("correct").alias("expect_result"), F.array(F.when(F.col("n") % 4 == 0, "zzz zzz").otherwise(F.col("text"))).alias("click_texts"))
    return R.answer_record_match(plan, _records(spark, sf))


def q_match(spark, sf):
    return _matched(spark, sf).select("run_id", "ord", "n", "result")


def q_unpredicted(spark, sf):
    t = _turns(spark, sf)
    records = _records(spark, sf).withColumn("course_id", F.col("run_id"))
    return R.unpredicted_records(records, t.select("course_id", "lms_id")).select("run_id", "n", "record_id")


def _runs(spark, sf):
    t = _turns(spark, sf)
    return t.groupBy("run_id").agg((F.count("*") % 5 == 0).alias("blocked")).withColumn("course_id", F.floor(F.col("run_id") / 3))


def _checks(spark, sf):
    t, runs = _turns(spark, sf), _runs(spark, sf)
    expected = runs.select("run_id", F.lit("completed").alias("completion_status"), F.when(F.col("run_id") % 2 == 0, "passed").alias("success_status"),
                           F.when(F.col("run_id") % 3 == 0, 0.5).alias("score_gte"), F.when(F.col("run_id") % 3 == 1, 0.5).alias("score_lt"), F.lit(True).alias("commit_seen"))
    totals = runs.select("run_id", (F.col("run_id") % 4).alias("n_commits"))
    submitted = t.filter("role <> 'system'").select("run_id", F.concat(F.lit("q"), F.col("turn").cast("string")).alias("interaction_id"))
    kinds = ("gate_hold", "item_reveal", "item_unreachable", "human_skip", "question_click", "slide_arrival")
    found = t.select("run_id", F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("n") % 6 + 1).cast("int")).alias("kind"),
                     F.concat(F.lit("s"), F.col("turn").cast("string")).alias("slide"), F.lit("x").alias("target"), (F.col("n") % 5 > 0).alias("ok"),
                     F.lit("Some  Text").alias("expected"), F.when(F.col("n") % 4 == 0, "other").otherwise("the some text").alias("observed"))
    return R.run_checks(R.outcome_checks(runs, _state(spark, sf), expected, totals), R.question_checks(_matched(spark, sf), submitted), R.finding_checks(found))


def q_checks(spark, sf):
    return _checks(spark, sf).groupBy("run_id", "check", "verdict", "ok").agg(F.count("*").alias("n"))


def q_coverage(spark, sf):
    t = _turns(spark, sf)
    route = t.select("run_id", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("slide_id"))
    visited = t.filter("n % 9 > 0").select("run_id", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("slide_id"))
    inv = t.select("run_id", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("slide_id"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("interaction_id"),
                   (F.col("turn") % 4 == 3).alias("is_survey"), (F.col("n") % 2 == 0).alias("drivable"))
    return R.run_coverage(_checks(spark, sf), route, visited, inv)


def q_verdict(spark, sf):
    return R.course_verdict(q_coverage(spark, sf), _runs(spark, sf))


QUERIES = {
    "screen_changes": q_changes, "settle_detect": q_settle, "utterance_to_screen": q_utterances, "api_state": q_api_state, "api_totals": q_api_totals,
    "interactions_from_state": q_interactions, "answer_record_match": q_match, "unpredicted_records": q_unpredicted, "run_checks": q_checks,
    "run_coverage": q_coverage, "course_verdict": q_verdict,
}

_POLLS = """p AS (SELECT user_id AS session_id, ts, event_id AS seq, CASE WHEN value < 20 THEN 'home' ELSE event_type END AS slide_id, floor(value / 8)::BIGINT::VARCHAR AS sig, value > 60 AS manual FROM events)"""
_T = """t AS (SELECT conv_id AS run_id, turn, min(text) AS text, min(role) AS role, length(min(text)) AS n, 'L' || lpad(turn::VARCHAR, 3, '0') AS lms_id FROM conversations GROUP BY ALL),
  runs AS (SELECT run_id, count(*) % 5 = 0 AS blocked, run_id // 3 AS course_id FROM t GROUP BY run_id),
  st AS (SELECT run_id, max(CASE WHEN turn = 0 THEN CASE WHEN n % 2 = 0 THEN 'completed' ELSE 'incomplete' END END) AS comp, max(CASE WHEN turn = 1 AND n % 5 > 0 THEN n % 100 / 100 END) AS score FROM t GROUP BY run_id),
  al AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS a FROM t),
  checks AS (
    SELECT run_id, 'completion:completion_status' AS "check", blocked, comp IS NOT NULL AND comp = 'completed' AS good FROM runs JOIN st USING (run_id)
    UNION ALL SELECT run_id, 'completion:success_status', blocked, false FROM runs WHERE run_id % 2 = 0
    UNION ALL SELECT run_id, 'completion:score.scaled', blocked, coalesce(CASE WHEN run_id % 3 = 0 THEN score >= 0.5 ELSE score < 0.5 END, false) FROM runs JOIN st USING (run_id) WHERE run_id % 3 < 2
    UNION ALL SELECT run_id, 'completion:commit', blocked, run_id % 4 > 0 FROM runs),
  allc AS (SELECT run_id, "check", CASE WHEN blocked THEN 'BLOCKED' ELSE 'VERIFIED' END AS verdict, CASE WHEN NOT blocked THEN good END AS ok FROM checks
    UNION ALL SELECT run_id, 'question:q' || turn, 'BLOCKED', NULL FROM t WHERE role = 'system'
    UNION ALL SELECT run_id, 'question:q' || turn || ':recorded', 'VERIFIED', false FROM t WHERE role <> 'system' AND n % 7 = 0
    UNION ALL SELECT run_id, 'question:q' || turn || ':result', 'VERIFIED', n % 3 <> 0 FROM t WHERE role <> 'system' AND n % 7 > 0
    UNION ALL SELECT run_id, 'question:q' || turn || ':response', 'VERIFIED', n % 4 <> 0 OR contains(a, 'zzzzzz') FROM al WHERE role <> 'system' AND n % 7 > 0
    UNION ALL SELECT run_id, CASE n % 6 WHEN 0 THEN 'gate_hold:s' || turn WHEN 1 THEN 'item:s' || turn || ':x' WHEN 2 THEN 'item:s' || turn || ':x' WHEN 3 THEN 'slide:s' || turn WHEN 4 THEN 'onscreen:s' || turn || ':x' ELSE 'arrival:s' || turn END,
      CASE WHEN n % 6 IN (2, 3) THEN 'UNCHECKED-BY-DESIGN' ELSE 'VERIFIED' END, CASE WHEN n % 6 IN (2, 3) THEN NULL WHEN n % 6 = 4 THEN n % 4 <> 0 ELSE n % 5 > 0 END FROM t WHERE n % 6 < 5 OR n % 5 = 0),
  cov AS (SELECT t.run_id, count(*) AS screens_of, count(*) FILTER (n % 9 > 0) AS screens_checked, count(*) FILTER (turn % 4 <> 3 AND n % 2 = 0) AS questions_of FROM t GROUP BY t.run_id),
  cnt AS (SELECT run_id, count(*) FILTER (verdict = 'VERIFIED' AND ok) AS n_pass, count(*) FILTER (verdict = 'VERIFIED' AND NOT coalesce(ok, false)) AS n_fail, count(*) FILTER (verdict = 'BLOCKED') AS n_blocked,
    count(*) FILTER (verdict = 'UNCHECKED-BY-DESIGN') AS n_by_design, count(*) FILTER ("check" LIKE 'question:%:result') AS questions_checked, count(*) FILTER ("check" LIKE 'item:%') AS items_checked,
    count(*) FILTER ("check" LIKE 'gate_hold:%' AND ok) AS gates_held FROM allc GROUP BY run_id),
  coverage AS (SELECT * FROM cov JOIN cnt USING (run_id))"""
ORACLE = {
    "screen_changes": f"WITH {_POLLS}, l AS (SELECT *, lag(slide_id) OVER (PARTITION BY session_id ORDER BY ts, seq) AS prev FROM p) SELECT session_id, seq, slide_id FROM l WHERE slide_id IS DISTINCT FROM prev",
    "settle_detect": f"""WITH {_POLLS}, l AS (SELECT *, lag(slide_id) OVER w IS DISTINCT FROM slide_id AS fresh, lag(sig) OVER w IS DISTINCT FROM sig AS moved FROM p WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
      v AS (SELECT *, sum(fresh::INT) OVER w::BIGINT AS visit, max(CASE WHEN fresh THEN ts END) OVER w AS arrived, max(CASE WHEN fresh OR moved THEN ts END) OVER w AS steady FROM l WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
      d AS (SELECT *, (epoch_us(ts) // 1000 - epoch_us(arrived) // 1000) / 3600000.0 AS el, (epoch_us(ts) // 1000 - epoch_us(steady) // 1000) / 3600000.0 AS hold FROM v),
      o AS (SELECT *, CASE WHEN el >= 1 AND hold >= 3 THEN 'settled' WHEN el >= 30 THEN 'needs_manual' WHEN manual THEN 'manual' END AS outcome FROM d),
      f AS (SELECT *, row_number() OVER (PARTITION BY session_id, visit ORDER BY ts, seq) AS rn FROM o WHERE outcome IS NOT NULL)
      SELECT session_id, visit, slide_id, seq, outcome FROM f WHERE rn = 1 AND outcome <> 'manual'""",
    "utterance_to_screen": """WITH c AS (SELECT * FROM events WHERE event_type = 'click'), v AS (SELECT user_id AS u, ts AS vts, value FROM events WHERE event_type = 'view')
      SELECT user_id AS session_id, event_id AS seq, props AS text, value_1::VARCHAR AS slide_id FROM (SELECT c.*, v.value AS value_1 FROM c ASOF LEFT JOIN v ON c.user_id = v.u AND c.ts >= v.vts)""",
    "api_state": """WITH s AS (SELECT user_id AS session_id, CASE WHEN event_type = 'signup' THEN 'cmi.interactions.' || (event_id % 7) || '.id' ELSE 'cmi.' || event_type END AS key, props, ts FROM events WHERE event_type NOT IN ('purchase', 'error'))
      SELECT session_id, key, arg_max(props, ts) AS value, count(*) AS n_sets FROM s GROUP BY ALL""",
    "api_totals": """SELECT user_id AS session_id, count(*) FILTER (event_type = 'purchase') AS n_commits, coalesce(max(CASE WHEN event_type = 'signup' THEN event_id % 7 END) + 1, 0)::INT AS n_interactions FROM events GROUP BY 1""",
    "interactions_from_state": f"""WITH {_T} SELECT run_id, turn::INT AS n, 'Scene_' || CASE WHEN n % 7 = 0 THEN 'other' ELSE lms_id END || '_1' AS record_id, CASE WHEN n % 3 = 0 THEN 'incorrect' ELSE 'correct' END AS result, md5(replace(lower(text), ' ', '_')) AS digest FROM t""",
    "answer_record_match": f"WITH {_T} SELECT run_id, turn AS ord, CASE WHEN n % 7 > 0 THEN turn END::INT AS n, CASE WHEN n % 7 > 0 THEN CASE WHEN n % 3 = 0 THEN 'incorrect' ELSE 'correct' END END AS result FROM (SELECT run_id, turn, n FROM t)".replace("n % 7 > 0 THEN turn END::INT AS n", "n % 7 > 0 THEN turn END::INT AS n"),
    "unpredicted_records": f"WITH {_T} SELECT run_id, turn::INT AS n, 'Scene_other_1' AS record_id FROM t WHERE t.n % 7 = 0",
    "run_checks": f'WITH {_T} SELECT run_id, "check", verdict, ok, count(*) AS n FROM allc GROUP BY ALL',
    "run_coverage": f"WITH {_T} SELECT * FROM coverage",
    "course_verdict": f"""WITH {_T}, g AS (SELECT course_id, n_fail = 0 AND n_blocked = 0 AND NOT blocked AND screens_checked >= screens_of AND questions_checked >= questions_of AS good FROM coverage JOIN runs USING (run_id))
      SELECT course_id, count(*) AS n_runs, count(*) FILTER (good) AS n_green, CASE WHEN bool_and(good) THEN 'GREEN' ELSE 'NEEDS WORK' END AS verdict FROM g GROUP BY 1""",
}
