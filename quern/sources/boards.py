"""Board and graph texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return _split(text.select(F.input_file_name().alias("file"), "value"))


def _split(docs: DataFrame) -> DataFrame:
    return docs.select("file", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("t"))


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """The boards of the files under path, by parse_boards(); board_id is the file."""
    text = spark.read.text(path, wholetext=True)
    return parse_boards(text.select(F.input_file_name().alias("board_id"), "value"), "value")


def parse_boards(docs: DataFrame, text: str = "text", board_id: str = "board_id") -> DataFrame:
    """board_id, strategy, player, depth, i, j, cell: 64 rows for each text of `strategy player depth` and a board.

    The 64 cells may stand together or apart. A text with fewer cells or
    other characters than X, O and * raises.
    """
    t = _split(docs.select(F.col(board_id).alias("file"), F.col(text).alias("value")))
    cells = F.array_join(F.slice("t", 4, 64), "")
    bad = F.raise_error(F.concat(F.lit("no board of 64 cells: "), F.col("file").cast("string")))
    cells = F.when(cells.rlike(r"^[XO*]{64}$"), cells).otherwise(bad)
    d = t.select(F.col("file").alias("board_id"), F.get("t", F.lit(0)).cast("int").alias("strategy"), F.get("t", F.lit(1)).alias("player"), F.get("t", F.lit(2)).cast("int").alias("depth"), cells.alias("c"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return d.select("board_id", "strategy", "player", "depth", F.expr("k div 8").cast("int").alias("i"), (F.col("k") % 8).alias("j"), F.substring("c", F.col("k") + 1, F.lit(1)).alias("cell"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, i, name) and edges (file, src, dst, w), w > 0, of texts with a task, two names, n, names and a matrix."""
    d = _tokens(spark, path).withColumn("n", F.get("t", F.lit(3)).cast("int"))
    nodes = d.select("file", F.posexplode(F.slice("t", F.lit(5), F.col("n"))).alias("i", "name"))
    matrix = d.select("file", "n", F.posexplode(F.slice("t", F.col("n") + 5, F.col("n") * F.col("n"))).alias("k", "v"))
    edges = matrix.select("file", F.expr("k div n").cast("int").alias("src"), (F.col("k") % F.col("n")).alias("dst"), F.col("v").cast("int").alias("w"))
    return nodes, edges.where("w > 0")


def board_text(cells: DataFrame) -> DataFrame:
    """board_id and its eight lines."""
    rows = cells.groupBy("board_id", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "cell"))), lambda x: x["cell"]), "").alias("line"))
    return rows.groupBy("board_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
