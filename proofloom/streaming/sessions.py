"""The session operators on streams, equal to their batch forms once drained.

Order decides the result, so rows wait in state until the watermark has passed
them and are then taken in (ts, seq) order.  Rows later than the watermark are
dropped; a session's state is its last screen and the rows still waiting.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.campaign import classify_outcome
from ..operators.sessions import HOLD_MS, MAX_MS, MIN_MS

STATE = "memory string, waiting string"


def in_order(rows: DataFrame, fields: list[str], fold: Callable, output: str, delay: str) -> DataFrame:
    """Feeds each session's rows to ``fold(memory, row) -> output row or None``
    in order; ``memory`` is a dict kept between rows."""
    columns = [c.strip().split()[0] for c in output.split(",")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, waiting = ({}, []) if not state.exists else map(json.loads, state.get)
        if not state.hasTimedOut:
            for frame in frames:
                for r in frame[["ms", "seq", *fields]].itertuples(index=False):
                    waiting.append([None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r])
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: (r[0], r[1]))
        ready = [r for r in waiting if r[0] < passed]
        waiting = waiting[len(ready):]
        out = []
        for r in ready:
            row = fold(memory, dict(zip(["ms", "seq", *fields], r)))
            if row is not None:
                out.append((key[0], *row))
        state.update((json.dumps(memory), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], passed) + 1)
        yield pd.DataFrame(out, columns=columns)

    timed = (rows.withWatermark("ts", delay)
             .select("session_id", "ts", F.unix_millis("ts").alias("ms"), "seq", *fields))
    return timed.groupBy("session_id").applyInPandasWithState(
        run, output, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def screen_changes(polls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    def fold(memory, row):
        if row["slide_id"] is None or memory.get("slide") == row["slide_id"]:
            return None
        memory["slide"] = row["slide_id"]
        return row["ms"], row["seq"], row["slide_id"]
    return in_order(polls, ["slide_id"], fold, "session_id long, ms long, seq long, slide_id string", delay)


def settle_detect(polls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    def fold(m, row):
        now = row["ms"]
        if "slide" not in m or m["slide"] != row["slide_id"]:
            m.update(slide=row["slide_id"], sig=row["text_signature"], arrived=now, steady=now, done=False,
                     visit=m.get("visit", 0) + 1)
        elif m["sig"] != row["text_signature"]:
            m.update(sig=row["text_signature"], steady=now)
        if m["done"]:
            return None
        elapsed, outcome = now - m["arrived"], None
        if elapsed >= MIN_MS and now - m["steady"] >= HOLD_MS:
            outcome = "settled"
        elif elapsed >= MIN_MS and elapsed >= MAX_MS:
            outcome = "needs_manual"
        m["done"] = outcome is not None or bool(row["manual"])
        return None if outcome is None else (m["visit"], m["slide"], now, row["seq"], outcome)
    return in_order(polls, ["slide_id", "text_signature", "manual"], fold,
                    "session_id long, visit long, slide_id string, ms long, seq long, outcome string", delay)


def utterance_to_screen(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``rows`` holds both logs: a screen change has slide_id, a spoken line text."""
    def fold(memory, row):
        if row["slide_id"] is not None:
            memory["slide"] = row["slide_id"]
            return None
        return row["ms"], row["seq"], row["text"], memory.get("slide")
    return in_order(rows, ["slide_id", "text"], fold,
                    "session_id long, ms long, seq long, text string, slide_id string", delay)


def outcome_stream(exports: DataFrame) -> DataFrame:
    """Users per sheet over all export rows that have arrived (update mode)."""
    return classify_outcome(exports).groupBy("sheet").agg(F.count("*").alias("n_users"))
