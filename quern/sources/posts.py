"""Posts: one JSON document per file with an array of posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "posts array<struct<id bigint, date string, title string, summary string, content string, tags array<string>>>, "
    "meta struct<last_updated string, total_posts bigint>"
)


def read_posts(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """file, pos and the fields of each post; pos is the place in the array, the only order that posts have.

    Missing or null posts are none. on_error="empty" gives no rows for an
    unreadable path and for documents that don't parse; "fail" raises.
    """
    if on_error not in ("fail", "empty"):
        raise ValueError("on_error is fail or empty")
    mode = {"mode": "FAILFAST"} if on_error == "fail" else {"mode": "PERMISSIVE"}
    try:
        docs = spark.read.schema(SCHEMA).options(multiLine=True, **mode).json(path)
    except AnalysisException:
        if on_error == "fail":
            raise
        docs = spark.createDataFrame([], SCHEMA).withColumn("_f", F.lit(""))
        return docs.select(F.col("_f").alias("file"), F.posexplode("posts").alias("pos", "p")).select("file", F.col("pos").cast("long").alias("pos"), "p.*")
    rows = docs.select(F.input_file_name().alias("file"), F.posexplode("posts").alias("pos", "p"))
    return rows.where("p is not null").select("file", F.col("pos").cast("long").alias("pos"), "p.*")


def parse(docs: DataFrame, json: str = "json") -> DataFrame:
    """The posts of a column of JSON documents: other columns, pos and the fields of each post. Documents that don't parse have none."""
    others = [c for c in docs.columns if c != json]
    rows = docs.select(*others, F.from_json(json, SCHEMA).alias("_d")).select(*others, F.posexplode("_d.posts").alias("pos", "p"))
    return rows.where("p is not null").select(*others, F.col("pos").cast("long").alias("pos"), "p.*")


def check_meta(spark: SparkSession, path: str) -> DataFrame:
    """file, stated and actual number of posts of each document, and whether they agree."""
    docs = spark.read.schema(SCHEMA).options(multiLine=True).json(path)
    n = F.coalesce(F.size("posts"), F.lit(0)).cast("long")
    return docs.select(F.input_file_name().alias("file"), F.col("meta.total_posts").alias("stated"), n.alias("actual")).withColumn("agrees", F.col("stated").eqNullSafe(F.col("actual")))


def items_html(docs: DataFrame, json: str = "json", items: str = "owl", field: str = "item", handler: Callable[[Column], Column] | None = None) -> DataFrame:
    """html in place of the JSON: the strings of one field of a document's items, joined in order, or what handler makes of the items."""
    data = F.from_json(json, f"{items} array<struct<{field} string>>")[items]
    join = handler or (lambda x: F.array_join(F.transform(x, lambda i: F.coalesce(i[field], F.lit(""))), ""))
    return docs.withColumn("html", join(data)).drop(json)


def gather_items(spark: SparkSession, path: str, items: str = "owl", field: str = "item") -> DataFrame:
    """html: the strings of one field of a document's items, joined in order."""
    docs = spark.read.schema(f"{items} array<struct<{field} string>>").options(multiLine=True).json(path)
    return docs.select(F.input_file_name().alias("file"), F.array_join(F.transform(items, lambda x: F.coalesce(x[field], F.lit(""))), "").alias("html"))
