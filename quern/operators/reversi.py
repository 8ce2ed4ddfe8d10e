"""Greedy Reversi moves for many boards at once, by standard rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import encode_cell, opposite

# What holding each cell is worth, row by row.
WEIGHTS = (
    (99, -8, 8, 6, 6, 8, -8, 99),
    (-8, -24, -4, -3, -3, -4, -24, -8),
    (8, -4, 7, 4, 4, 7, -4, 8),
    (6, -3, 4, 0, 0, 4, -3, 6),
    (6, -3, 4, 0, 0, 4, -3, 6),
    (8, -4, 7, 4, 4, 7, -4, 8),
    (-8, -24, -4, -3, -3, -4, -24, -8),
    (99, -8, 8, 6, 6, 8, -8, 99),
)
#: A move must score more than this.
LEAST = -10


#: For each cell the cells of its rays in the eight directions, nearest first.
RAYS = tuple(
    tuple(
        tuple((i + s * a) * 8 + j + s * b for s in range(1, 8) if 0 <= i + s * a < 8 and 0 <= j + s * b < 8)
        for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b
    )
    for i in range(8) for j in range(8)
)


def _constant(values, kind: str) -> Column:
    """A constant array, built once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _packed(cells: DataFrame) -> DataFrame:
    """board_id, player, opp, b: a board's 64 cells as one string. A board has 64 rows, so groups are small."""
    rows = F.array_sort(F.collect_list(F.struct("i", "j", "cell")))
    boards = cells.groupBy("board_id", "player").agg(F.array_join(F.transform(rows, lambda x: x["cell"]), "").alias("b"))
    return boards.withColumn("opp", opposite(F.col("player")))


def _at(k: Column) -> Column:
    return F.substring("b", k + 1, F.lit(1))


def _turned(k: Column) -> Column:
    """The cells that a move to k flips: on each ray a run of the opponent's discs that ends in an own one."""

    def run(ray: Column) -> Column:
        seen = F.array_join(F.transform(ray, _at), "")
        length = F.when(F.col("opp") == "O", F.length(F.regexp_extract(seen, "^(O+)X", 1))).otherwise(F.length(F.regexp_extract(seen, "^(X+)O", 1)))
        return F.slice(ray, F.lit(1), length)

    return F.array_sort(F.flatten(F.transform(F.get(_constant(RAYS, "array<array<array<int>>>"), k), run)))


def _moves(boards: DataFrame) -> DataFrame:
    """Adds m: each legal move with its cell, the cells flipped and its score, own weights before the move less the opponent's after it.

    All within a board's row: nothing is exploded or shuffled.
    """
    weights = _constant([w for row in WEIGHTS for w in row], "array<int>")
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    standing = total(F.transform(weights, lambda w, k: F.when(_at(k) == F.col("player"), w).when(_at(k) == F.col("opp"), -w).otherwise(0)))
    empty = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: _at(k) == "*")
    tried = boards.withColumn("_standing", standing).withColumn("_m", F.transform(empty, lambda k: F.struct(k.alias("k"), _turned(k).alias("flipped"))))
    legal = F.filter("_m", lambda m: F.size(m["flipped"]) > 0)
    scored_ = F.transform(
        legal,
        lambda m: F.struct(
            encode_cell(F.floor(m["k"] / 8).cast("int"), m["k"] % 8).alias("cell"),
            (F.col("_standing") + total(F.transform(m["flipped"], lambda c: F.get(weights, c)))).alias("score"),
            m["k"].alias("k"),
            m["flipped"].alias("flipped"),
        ),
    )
    return tried.withColumn("m", scored_).drop("_m", "_standing")


def _after() -> Column:
    """The board after move m."""
    taken = lambda k: (k == F.col("m.k")) | F.array_contains(F.col("m.flipped"), k)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(taken(k), F.col("player")).otherwise(_at(k))), "")


def scored(cells: DataFrame) -> DataFrame:
    """board_id, player, opp, b, cell, flipped, score, after: every legal move, the cells it flips, its score and the board it leaves."""
    each = _moves(_packed(cells)).withColumn("m", F.explode("m"))
    return each.select("board_id", "player", "opp", "b", "m.cell", "m.flipped", "m.score", _after().alias("after"))


def greedy(cells: DataFrame) -> DataFrame:
    """board_id, player, cell, score, after: each board's best move, the smallest cell among equals; no row without one."""
    ranked = F.transform(F.filter("m", lambda m: m["score"] > LEAST), lambda m: F.struct((-m["score"]).alias("s"), m["cell"].alias("cell"), m["k"].alias("k"), m["flipped"].alias("flipped")))
    best = _moves(_packed(cells)).withColumn("m", F.array_min(ranked)).where("m is not null")
    return best.select("board_id", "player", "m.cell", (-F.col("m.s")).alias("score"), _after().alias("after"))
