"""A training corpus from raw documents: five stages, each an operator of ``proofloom.llm`` over all that is left.

Documents of low quality go, one of each group of near copies stays, passages stated before are cut out, sources
are mixed to their weights, and the mix is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import mixing, ngram_join, packing, quality, suffixes
from proofloom.llm.catalog import vocabulary
from proofloom.llm.common import keep

# The lowest score that stays.
QUALITY = 0.7


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is QUALITY or more; the classifier is fitted on the labelled ones among them."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, model, name="__score").filter(F.col("__score") >= QUALITY).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that share 80 in 100 of their five-word shingles, directly or by way of others."""
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that an earlier document, or the same one before, has stated."""
    cut = suffixes.without_repeats(docs, least=100)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the columns they came with."""
    # Columns named like those of the mix go by other names through it.
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies", "copy_no", "weight")}
    mix = mixing.emit_mix(mixing.plan_mix(docs.withColumnsRenamed(own)))
    return mix.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix, in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality classifier", good_documents), ("n-gram Jaccard join", distinct_documents),
          ("suffix-array dedup", without_repeats), ("source mixing", mixed_sources), ("packing", packed)]

# Tokens and trained weights are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
