"""Chat formatting: conversations as budgeted windows of marked turns with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and those of earlier turns that it may repeat.
BUDGET, HISTORY = 512, 128
#: Rough tokens of a turn: words and single other characters, and three for the marks.
PIECES, MARKS = r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]", 3
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """Texts cannot form a mark afterwards; unescape() restores them exactly."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~2"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~2"), F.lit("\n")))


def windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokens: str | None = None,
) -> DataFrame:
    """One row per window: conv_id, window, tokens, formatted, repeated, loss.

    Each window holds whole turns in order: the conversation's system turn if
    its first turn is one, then the last turns of the window before that fit
    into `history` tokens and into the budget, then its own. Every turn
    belongs to one window. The first `repeated` turns of a window are copies
    from earlier; loss lists the spans of code points, from 0, that assistant
    texts of its own have in `formatted`, so each is trained on once.

    No window has more than `budget` tokens, unless it is a single turn that
    has. A system turn of more than half of the budget less the history is a
    turn like others and not repeated; a turn that doesn't fit beside the
    system turn stands without it.

    Windows come from prefix sums of turn tokens: the sums are cut at
    multiples of the budget less the history and the system turn; a turn that
    crosses a cut is a window of its own. `tokens` names a column with the
    tokens of each text by the model's tokenizer; without it words and single
    other characters are counted. MARKS are added for a turn's marks.

    Null text and null roles count as empty, null tokens as none. Turns are
    ordered by turn, nulls first, then role and text; equal rows are repeated
    turns. Rows with a null conv_id are one conversation. Other columns are
    ignored; an empty table gives no rows.
    """
    counted = F.regexp_count("_text", F.lit(PIECES)) if tokens is None else F.coalesce(F.col("_tokens"), F.lit(0))
    t = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        *([] if tokens is None else [F.col(tokens).alias("_tokens")]),
    ).withColumn("_n", (counted + MARKS).cast("long"))
    by = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening = F.concat(F.lit(START), _escape_role(F.col("_role")), F.lit("\n"))
    t = t.withColumn("_piece", F.concat(opening, escape(F.col("_text")), F.lit(END + "\n"))).withColumn("_from", F.length(opening).cast("long"))
    t = t.withColumn("_i", F.row_number().over(by).cast("long")).withColumn("_end", F.sum("_n").over(upto))
    first = lambda c: F.first(c).over(by)
    short = (first("_role") == "system") & (first("_n") <= (budget - history) // 2)
    t = t.withColumn("_sys", F.when(short, first("_n")).otherwise(F.lit(0)))
    t = t.withColumn("_step", F.greatest(F.lit(1), F.lit(budget - history) - F.col("_sys")))
    before = F.col("_end") - F.col("_n")
    crosses = F.floor(before / F.col("_step")) < F.floor((F.col("_end") - 1) / F.col("_step"))
    t = t.withColumn("_cell", F.floor(before / F.col("_step")) * 2 + crosses.cast("long"))
    # Windows are numbered without gaps.
    t = t.withColumn("_new", (F.col("_cell") != F.coalesce(F.lag("_cell").over(by), F.lit(-1))).cast("long"))
    t = t.withColumn("window", F.sum("_new").over(upto) - 1)
    full = Window.partitionBy("conv_id", "window").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_last", F.max("_end").over(full)).withColumn("_own", F.sum("_n").over(full))
    # What the next window has to hold tells which turns of this one it can repeat.
    t = t.withColumn("_follow", F.last(F.lead("_own").over(by)).over(full))

    room = F.lit(budget) - F.col("_follow")
    left = F.when(F.col("_sys") <= room, room - F.col("_sys")).otherwise(room)
    head = (F.col("_sys") > 0) & (F.col("_i") == 1)
    again = ~head & F.col("_follow").isNotNull() & (F.col("_last") - before <= F.least(F.lit(history), left))
    opens = (F.col("_new") == 1) & (F.col("window") > 0) & (F.col("_sys") > 0) & (F.col("_sys") + F.col("_own") <= budget)
    piece = lambda at, i, n, s, copy: F.struct(
        at.alias("at"), i.alias("i"), n.alias("n"), s.alias("s"), F.lit(copy).alias("copy"), (F.lit(not copy) & (F.col("_role") == TRAINED)).alias("train"), F.col("_from").alias("from")
    )
    # The head is written where a window opens, so the system turn's row is not copied for each window.
    pieces = F.array(
        piece(F.col("window"), F.col("_i"), F.col("_n"), F.col("_piece"), False),
        F.when(again, piece(F.col("window") + 1, F.col("_i"), F.col("_n"), F.col("_piece"), True)),
        F.when(opens, piece(F.col("window"), F.lit(0).cast("long"), F.col("_sys").cast("long"), F.col("_head"), True)),
    )
    t = t.withColumn("_head", F.when(opens, first("_piece")))
    t = t.select("conv_id", F.explode(F.array_compact(pieces)).alias("_q")).select("conv_id", F.col("_q.at").alias("_at"), F.col("_q.n").alias("_n"), F.col("_q").alias("_p"))

    piece = F.struct("_p.i", "_p.s", F.length("_p.s").cast("long").alias("n"), "_p.copy", "_p.train", "_p.from")
    w = t.groupBy("conv_id", F.col("_at").alias("window")).agg(F.array_sort(F.collect_list(piece)).alias("_p"), F.sum("_n").alias("tokens"))
    placed = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("loss")),
        lambda a, p: F.struct(
            (a["at"] + p["n"]).alias("at"),
            F.when(
                p["train"],
                F.concat(a["loss"], F.array(F.struct((a["at"] + p["from"]).alias("start"), (a["at"] + p["n"] - len(END) - 1).alias("end")))),
            )
            .otherwise(a["loss"])
            .alias("loss"),
        ),
        lambda a: a["loss"],
    )
    return w.select(
        "conv_id", "window", "tokens", F.array_join("_p.s", "").alias("formatted"), F.size(F.filter("_p", lambda p: p["copy"])).alias("repeated"), placed.alias("loss")
    )


def turns(formatted: DataFrame) -> DataFrame:
    """The turns that windows hold, each once: conv_id, window, n, role, text."""
    parts = F.split("formatted", START.replace("|", r"\|"), -1)
    own = F.slice(parts, F.col("repeated") + 2, F.greatest(F.size(parts) - 1 - F.col("repeated"), F.lit(0)))
    p = formatted.select("conv_id", "window", F.posexplode(own).alias("n", "_p"))
    role = F.substring_index("_p", "\n", 1)
    return p.select(
        "conv_id",
        "window",
        "n",
        _unescape_role(role).alias("role"),
        unescape(F.substring("_p", F.length(role) + 2, F.length("_p") - F.length(role) - 1 - len(END) - 1)).alias("text"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.split("formatted", START.replace("|", r"\|"), -1)
    own = F.slice(parts, F.col("repeated") + 2, F.greatest(F.size(parts) - 1 - F.col("repeated"), F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.concat(_unescape_role(role), F.lit("\n"), unescape(body), F.lit("\n"))

    trained = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    w = formatted.select(
        "conv_id",
        F.struct(
            "window",
            F.size(own).cast("long").alias("n"),
            F.array_join(F.transform(own, turn), "").alias("turns"),
            F.array_join(trained, "").alias("loss"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda c: F.aggregate(F.col(f"w.{c}"), F.lit(0).cast("long"), lambda a, x: a + x)
    sha = lambda c: F.sha2(F.encode(F.array_join(F.col(f"w.{c}"), ""), "UTF-8"), 256)
    return g.select(
        "conv_id", total("n").alias("n_turns"), sha("turns").alias("turns_sha256"), F.length(F.array_join("w.loss", "")).cast("long").alias("loss_chars"),
        sha("loss").alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )
