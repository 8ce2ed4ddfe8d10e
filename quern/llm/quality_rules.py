"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD, SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this from or at an not have but they his which you "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son "
    "el los que y del las por con para una su al lo como más pero sus"
).split()


class Rule(NamedTuple):
    """A document passes if low <= measure <= high; None is no bound."""

    measure: str
    low: float | None
    high: float | None


#: Production thresholds. Ratios are to the words of a document, line ratios to its lines with a word.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("mark_ratio", None, 0.6),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    d = docs.select(
        F.col(doc_id).alias("doc_id"),
        words.alias("_w"),
        lines.alias("_l"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, "[^!]+", "")).alias("_marks"),
    )
    n = F.size("_w")
    # Each window of three words as (hash, start), in order of hash: repeats become neighbours.
    hashed = F.transform(
        "_w", lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p"))
    )
    triples = F.sort_array(F.slice(hashed, F.lit(1), F.greatest(n - 2, F.lit(0))))
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "_marks",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").alias("_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
        triples.alias("_t"),
    )
    hash_at = lambda i: F.get("_t", i)["h"]
    repeated = F.filter("_t", lambda x, i: hash_at(i - 1).eqNullSafe(x["h"]) | hash_at(i + 1).eqNullSafe(x["h"]))
    starts = F.sort_array(F.transform(repeated, lambda x: x["p"]))
    d = d.withColumn("_s", starts).drop("_t")
    covered = F.aggregate(
        "_s",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    return d.withColumn("n_repeat_words", covered)


def _ratio_of(count: str, total: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(total) > 0, F.col(count) / F.col(total)).otherwise(0.0)


#: What a threshold can refer to.
MEASURES = {
    "mean_word_chars": _ratio_of("word_chars", "n_words"),
    "symbol_ratio": _ratio_of("n_symbols", "n_words"),
    "mark_ratio": _ratio_of("_marks", "n_words"),
    "stop_ratio": _ratio_of("_stops", "n_words"),
    "dup_line_ratio": _ratio_of("n_dup_lines", "_lines"),
}


def compile_rules(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The verdict and the names of the failed rules, as two expressions."""
    failed = []
    for r in rules:
        x = MEASURES[r.measure]()
        for bound, bad in ((r.low, lambda b, x=x: x < b), (r.high, lambda b, x=x: x > b)):
            if bound is not None:
                failed.append((r.measure, bad(bound)))
    if not failed:
        return F.lit(True), F.lit("")
    verdict = ~failed[0][1]
    for _, bad in failed[1:]:
        verdict = verdict & ~bad
    names = F.array_join(F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in failed))), ",")
    return verdict, names


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts, base_failed, kept and the failed rules.

    Null text counts as empty: no words, base_failed. Ratios to nothing are 0.
    Rows are judged one by one, so repeated rows, ties and null ids change
    nothing; other columns are ignored; an empty table gives no rows.

    A map-only job: all rules are one projection of built-in functions. Each
    three-word window stands for itself by a 64-bit hash; in one document of
    20,000 words two differ yet collide with a chance of about 1e-11.
    """
    d = _measured(docs, doc_id, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict, names = compile_rules(rules)
    # Always true, but it keeps a caller's filter on kept above this projection: pushed below, it would split each text many times.
    verdict = verdict & (F.monotonically_increasing_id() >= 0)
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return d.select(*counts, base.alias("base_failed"), (~base & verdict).alias("kept"), names.alias("failed_rules"))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Null and empty texts go. No shuffle."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    judged = judge(row, rules, "_row", "_text")
    # What an outer explode gives is filtered above it, so the texts are split once.
    return judged.select("doc_id", F.explode_outer(F.when(F.col("kept"), F.array(F.lit(True)))).alias("_kept")).where("_kept is not null").select("doc_id.*")
