"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; run() writes what a stage returns as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules, queries
from quern.llm.shared import stage


#: Shares of all tokens that the mixture is to have. If the rules leave no labelled low document, its share goes to the others.
TARGETS = queries.TARGETS
#: Words of a shingle and least similarity in hundredths for near-duplicates here; op7's query has its own.
NEAR_K, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return jaccard_join.representatives(docs, k=NEAR_K, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that domains have their target shares."""
    return mixing.resample(docs, queries.labelled(spark, sf_dir), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("mixing", mix), ("packing", pack)]

#: Mixing and packing are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
