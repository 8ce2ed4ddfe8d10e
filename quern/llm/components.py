"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node with an edge (u, v); root is the smallest node of its component.

    Alternates large-star and small-star steps until all edges form stars.
    Minima are aggregated before they are shuffled; each step is staged, and
    the one before deleted.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        # Stars: no node is both an end and a centre, and no end has two centres.
        places = new.select("u", F.lit(1).alias("end"), F.lit(0).alias("centre")).unionByName(new.select(F.col("v").alias("u"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
        discard(edges, large)
        edges = new
        if places.groupBy("u").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre")).where("ends + centre > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
