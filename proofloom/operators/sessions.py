"""Ordered session logs in batch: screen changes, settling, spoken lines, API state.

Tables carry session_id, ts and seq, where (ts, seq) orders a session.  A
session may be arbitrarily long: order-dependent steps run in chunks of time
(see ``spread``).  ``chunk_seconds`` only trades task size against summary size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import last_known, previous_row, running_sum, time_chunk

# Fixed values, in milliseconds: nothing before MIN, unchanged for HOLD settles, MAX gives up.
MIN_MS, HOLD_MS, MAX_MS = 600, 1400, 40000
KEY, ORDER = ["session_id"], ["ts", "seq"]


def screen_changes(polls: DataFrame, chunk_seconds: int = 86400) -> DataFrame:
    """Polls whose screen differs from the one polled before."""
    known = polls.filter(F.col("slide_id").isNotNull())
    rows = previous_row(known, KEY, ORDER, ["slide_id"], time_chunk(F.col("ts"), chunk_seconds))
    return (rows.filter(~F.col("slide_id").eqNullSafe(F.col("prev_slide_id")))
            .select("session_id", "ts", "seq", "slide_id"))


def settle_detect(polls: DataFrame, chunk_seconds: int = 86400, min_ms: int = MIN_MS,
                  hold_ms: int = HOLD_MS, max_ms: int = MAX_MS) -> DataFrame:
    """Each visit to a screen that settled or needs a manual capture.

    Columns of ``polls``: slide_id, text_signature, manual (a capture taken by
    hand, which closes the visit).  A visit gets at most one outcome, at the
    first poll that decides it.
    """
    def chunk():
        return time_chunk(F.col("ts"), chunk_seconds)
    rows = previous_row(polls, KEY, ORDER, ["slide_id", "text_signature"], chunk())
    fresh = ~F.col("slide_id").eqNullSafe(F.col("prev_slide_id")) | F.col("prev_slide_id").isNull()
    rows = rows.withColumn("fresh", fresh).withColumn(
        "changed", fresh | ~F.col("text_signature").eqNullSafe(F.col("prev_text_signature")))
    rows = rows.drop("prev_slide_id", "prev_text_signature")
    rows = last_known(rows, KEY, ORDER, ["ts"], F.col("fresh"), chunk(), "arrived_")
    rows = last_known(rows, KEY, ORDER, ["ts"], F.col("changed"), chunk(), "steady_")
    rows = running_sum(rows, KEY, ORDER, F.col("fresh").cast("int"), chunk(), "visit")
    now = F.unix_millis("ts")
    elapsed, stable = now - F.unix_millis("arrived_ts"), now - F.unix_millis("steady_ts")
    outcome = (F.when((elapsed >= min_ms) & (stable >= hold_ms), "settled")
               .when((elapsed >= min_ms) & (elapsed >= max_ms), "needs_manual").when(F.col("manual"), "manual"))
    decided = rows.withColumn("outcome", outcome).filter(F.col("outcome").isNotNull())
    first = decided.groupBy("session_id", "visit").agg(F.min_by(
        F.struct("slide_id", "ts", "seq", "outcome"), F.struct("ts", "seq")).alias("d"))
    return first.select("session_id", "visit", "d.*").filter(F.col("outcome") != "manual")


def utterance_to_screen(utterances: DataFrame, changes: DataFrame, chunk_seconds: int = 86400) -> DataFrame:
    """Each spoken line under the screen showing when it was said (as-of)."""
    said = utterances.select("session_id", "ts", "seq", "text", F.lit(None).cast("string").alias("slide_id"), F.lit(True).alias("__said"))
    shown = changes.select("session_id", "ts", "seq", F.lit(None).cast("string").alias("text"), "slide_id", F.lit(False).alias("__said"))
    rows = last_known(said.unionByName(shown), KEY, ORDER, ["slide_id"], ~F.col("__said"), time_chunk(F.col("ts"), chunk_seconds))
    return rows.filter("__said").select("session_id", "ts", "seq", "text", F.col("last_slide_id").alias("slide_id"))


def api_state(calls: DataFrame) -> DataFrame:
    """Last value of every key a session set, with how often it was set.

    ``calls`` has fn and args (key, value).  An aggregation only, so it runs
    on a stream unchanged.
    """
    sets = calls.filter(F.col("fn").isin("SetValue", "LMSSetValue"))
    return (sets.groupBy("session_id", F.col("args")[0].alias("key"))
            .agg(F.max_by(F.col("args")[1], F.struct("ts", "seq")).alias("value"), F.count("*").alias("n_sets")))


def api_totals(calls: DataFrame) -> DataFrame:
    """Commits and the size of each numbered collection per session."""
    index = F.regexp_extract(F.col("args")[0], r"^cmi\.interactions\.(\d+)\.", 1)
    number = F.when(F.col("fn").isin("SetValue", "LMSSetValue") & (index != ""), index.try_cast("int"))
    return calls.groupBy("session_id").agg(
        F.count_if(F.col("fn").isin("Commit", "LMSCommit")).alias("n_commits"),
        F.coalesce(F.max(number) + 1, F.lit(0)).alias("n_interactions"))
