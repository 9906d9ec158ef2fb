"""Registered queries: an operator over whole test tables, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Tables whose rows cost real work (texts, or rows that write documents).
HEAVY = {"documents", "pages", "conversations", "orders", "customer"}


def few_splits(df: DataFrame) -> bool:
    """Whether the scan cuts a table into fewer splits than there are cores."""
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table.  A heavy one that the scan cuts into fewer splits than there
    are cores (one small file, one row group) is spread over the cores; data of
    cluster size has more splits than that and is never shuffled here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if name in HEAVY and few_splits(df) else df


def load() -> tuple[dict, dict]:
    """All (queries, oracle SQL) of the catalogue modules."""
    from . import campaigns, orders, packages, payloads, reading, report, sessions, sites, texts
    queries, oracle = {}, {}
    for module in (texts, campaigns, orders, sites, packages, payloads, sessions, reading, report):
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
