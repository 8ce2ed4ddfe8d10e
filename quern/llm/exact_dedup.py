"""Exact dedup: heavy-hitter split of text digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import among, choose, frequent, stage


def text_digest(text: str = "text"):
    return F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical; null equals empty. Of equal texts the row
    with the largest doc_id stays. A null doc_id stays only among nulls. Of
    repeated rows that tie for the largest doc_id one is kept. An empty table
    gives no rows; other columns are ignored.

    The texts are read once; only ids and digests are staged and shuffled.
    Frequent digests are settled against a broadcast of at most 256 rows.
    """
    row = (F.col(doc_id).alias("doc_id"), F.col(doc_id).isNotNull().alias("_known"), F.monotonically_increasing_id().alias("_n"))
    rows = stage(docs.select(*row, text_digest(text).alias("text_sha256")), "digests")
    return choose(rows, "text_sha256", ("_known", "doc_id", "_n"), largest=True).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), F.col("first").alias("kept"), "text_sha256"
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each text, that of the largest doc_id; all columns stay.

    Rows of a frequent digest are dropped before any shuffle: per digest the
    one row that stays is found by partial aggregation and added back, at most
    256 rows. The others meet by digest. Ties and nulls as in annotate().
    """
    columns = docs.columns
    row = docs.select(text_digest(text).alias("_k"), F.struct(*columns).alias("_r"))
    digests = stage(row.select("_k"), "digests")
    counted = among(digests, "_k", frequent(digests, "_k")).groupBy("_k").count().where("count > 1").select("_k")
    heavy = stage(counted, "winners")
    order = F.col("_r").getField(doc_id)
    won = row.join(F.broadcast(heavy), "_k").groupBy("_k").agg(
        F.coalesce(F.max_by("_r", order), F.any_value("_r")).alias("_r")  # max_by passes over null ids
    )
    light = row.join(F.broadcast(heavy), "_k", "left_anti").withColumn(
        "_n", F.row_number().over(Window.partitionBy("_k").orderBy(order.desc_nulls_last()))
    )
    return light.where("_n = 1").select("_r.*").unionByName(won.select("_r.*"))
