"""The queries opN_<name> and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat_format, exact_dedup, jaccard_join, license_scan, mixing, packing, quality_classifier, quality_rules, substring_dedup, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("spans")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat_format.END}{chat_format.START}assistant ok"
    more = spark.sql(
        f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    every = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digest(chat_format.windows(every))


#: Shares of all tokens that the mixture is to have.
TARGETS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each labelled document."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return read(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), labelled(spark, sf_dir), TARGETS)
    shares = [F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS))]
    return mixed.select("doc_id", "source", "tokens", *shares, "rate", "copies")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The JSON of an installed public tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_chat_format": op8_chat_format,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
}
