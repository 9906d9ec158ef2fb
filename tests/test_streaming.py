"""A drained stream gives what the batch form gives, files out of order included."""

import pytest
from pyspark.sql import functions as F

from proofloom.catalog import campaigns, sessions as catalog
from proofloom.operators import campaign as K
from proofloom.operators import sessions as B
from proofloom.streaming import sessions as S
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, path):
    """The rows as a file stream in two files, neighbours split between them, and
    one much later row of another session that moves the watermark past them."""
    last = df.limit(1).withColumn("session_id", F.lit(-1).cast("bigint")).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    for i, part in enumerate((df.filter("seq % 2 = 0"), df.filter("seq % 2 = 1"), last)):
        part.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def drain(spark, stream, name, path, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(path / f"cp_{name}")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_screen_changes(spark, tmp_path):
    polls = catalog.polls(spark, SF).select("session_id", "ts", "seq", "slide_id")
    got = drain(spark, S.screen_changes(as_stream(spark, polls, tmp_path / "in"), "400 days"), "changes", tmp_path)
    assert rows(got.filter("session_id >= 0"), "session_id", "seq", "slide_id") == rows(B.screen_changes(polls), "session_id", "seq", "slide_id")


def test_settle_detect(spark, tmp_path):
    base = catalog.polls(spark, SF)
    fast = F.timestamp_millis((F.unix_millis("ts") / 20000).cast("bigint") + 1700000000000)
    polls = base.withColumn("ts", fast)
    got = drain(spark, S.settle_detect(as_stream(spark, polls, tmp_path / "in"), "400 days"), "settled", tmp_path)
    want = B.settle_detect(polls)
    assert rows(got.filter("session_id >= 0"), "session_id", "visit", "seq", "outcome") == rows(want, "session_id", "visit", "seq", "outcome")
    assert want.count() > 5


def test_utterances(spark, tmp_path):
    e = campaigns.events(spark, SF).select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), "event_type", "props")
    both = e.filter("event_type IN ('click', 'view')").select(
        "session_id", "ts", "seq", F.when(F.col("event_type") == "view", F.concat(F.lit("s"), "seq")).alias("slide_id"),
        F.when(F.col("event_type") == "click", F.col("props")).alias("text"))
    got = drain(spark, S.utterance_to_screen(as_stream(spark, both, tmp_path / "in"), "400 days"), "spoken", tmp_path)
    want = B.utterance_to_screen(both.filter("text IS NOT NULL"), both.filter("slide_id IS NOT NULL"))
    assert rows(got.filter("session_id >= 0"), "session_id", "seq", "slide_id") == rows(want, "session_id", "seq", "slide_id")


def test_api_state(spark, tmp_path):
    calls = catalog._calls(spark, SF)
    got = drain(spark, B.api_state(as_stream(spark, calls, tmp_path / "in")), "state", tmp_path, "complete")
    assert rows(got.filter("session_id >= 0"), "session_id", "key", "value", "n_sets") == rows(B.api_state(calls), "session_id", "key", "value", "n_sets")


def test_outcomes(spark, tmp_path):
    exports = campaigns.exports(spark, SF)
    exports.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(exports.schema).parquet(str(tmp_path / "in"))
    got = drain(spark, S.outcome_stream(stream), "outcomes", tmp_path, "complete")
    want = K.classify_outcome(exports).groupBy("sheet").agg(F.count("*").alias("n_users"))
    assert rows(got, "sheet", "n_users") == rows(want, "sheet", "n_users")


@pytest.mark.parametrize("late", [True, False])
def test_rows_behind_the_watermark_are_dropped(spark, tmp_path, late):
    schema = "session_id bigint, ts timestamp, seq bigint, slide_id string"
    first = spark.createDataFrame([(1, 1000, 1, "a"), (2, 9000, 2, "z")], "session_id bigint, s bigint, seq bigint, slide_id string")
    second = spark.createDataFrame([(1, 1100 if late else 9500, 3, "b"), (2, 20000, 4, "y")], first.schema)
    path, src = str(tmp_path / "in"), None
    timed = lambda d: d.select("session_id", F.timestamp_seconds("s").alias("ts"), "seq", "slide_id")
    timed(first).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(schema).parquet(path)
    name = f"late_{late}".lower()
    q = (S.screen_changes(src, "10 seconds").writeStream.format("memory").queryName(name)
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    try:
        q.processAllAvailable()
        timed(second).coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    finally:
        q.stop()
    assert (1, "b") in rows(spark.table(name), "session_id", "slide_id") or late
    assert late != ((1, "b") in rows(spark.table(name), "session_id", "slide_id"))
