"""Chunked ordered work equals one plain window, hot key or not."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofloom.operators import spread as P
from proofloom.operators.stored import stored
from tests.conftest import rows


def events(spark):
    """One key owns two thirds of the rows; ids are unique, values repeat."""
    return spark.range(900).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"),
                                   (F.col("id") * 37 % 11).alias("v"), F.timestamp_seconds(F.col("id") * 50).alias("ts"))


def test_previous_row(spark):
    e = events(spark)
    got = P.previous_row(e, ["k"], ["ts", "id"], ["v"], P.time_chunk(F.col("ts"), 1000))
    want = e.withColumn("prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("ts", "id")))
    assert rows(got, "id", "prev_v") == rows(want, "id", "prev_v")


def test_last_known(spark):
    e = events(spark)
    hit = F.col("v") == 4
    got = P.last_known(e, ["k"], ["id"], ["id"], hit, P.id_chunk(F.col("id"), 13))
    w = Window.partitionBy("k").orderBy("id")
    want = e.withColumn("last_id", F.last(F.when(hit, F.col("id")), ignorenulls=True).over(w))
    assert rows(got, "id", "last_id") == rows(want, "id", "last_id")


def test_running_sum(spark):
    e = events(spark)
    got = P.running_sum(e, ["k"], ["id"], F.col("v"), P.id_chunk(F.col("id"), 10), "s")
    want = e.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("id")))
    assert rows(got, "id", "s") == rows(want, "id", "s")


def test_salted_join_equals_join(spark):
    e = events(spark)
    small = spark.createDataFrame([(0, "zero"), (3, "three")], "k bigint, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(P.salted_join(e, small, ["k"], how).drop("ts")) == rows(e.join(small, "k", how).select(
            P.salted_join(e, small, ["k"], how).columns).drop("ts"))


def test_top_n_is_limited_before_the_shuffle(spark):
    top = P.top_n_per_key(events(spark), ["k"], [F.col("id")], 2)
    assert len(top.collect()) == 2 * 7 - 0
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_salted_join_sends_no_repeated_side_to_the_driver(spark):
    big = stored(spark.range(20).withColumnRenamed("id", "k").withColumn("v", F.lit("a")), "test")
    small = stored(spark.range(5).withColumnRenamed("id", "k").withColumn("w", F.lit("b")), "test")
    joined = P.salted_join(big, small, ["k"])
    assert joined.count() == 5 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
