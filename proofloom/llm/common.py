"""Shared pieces: written tables on the cluster's shared folder and word splitting."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import CLEAN, shared_folder

# White space that ends a word, and its complement.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = re.compile(r"[\x20\x09-\x0D]")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at 4 MB, so a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: ``df`` written once to the shared folder and read back.

    A lost executor loses nothing of it.  Shuffle files behind the write go when it has ended.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_words(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z lower-cased.  ``bytes`` methods know ASCII only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in parts of about ``size`` characters, cut before the white space that ends a word only."""
    start = 0
    while len(text) - start > size:
        end = BLANK.search(text, start + size)
        if not end:
            break
        yield text[start:end.start()]
        start = end.start()
    yield text[start:]
