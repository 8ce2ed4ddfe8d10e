"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_MINUTE = 220


def strip_tags(html: Column) -> Column:
    """Each tag becomes one space; null becomes ''."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")


def trim_space(text: Column) -> Column:
    """Cuts ASCII white space at both ends; other spaces stay."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Pieces between runs of white space; empty text counts as one."""
    return F.size(F.split(trim_space(F.coalesce(text, F.lit(""))), r"\s+"))


def read_minutes(words: Column) -> Column:
    """Minutes at 220 words each, half rounded up, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(words / F.lit(float(WORDS_PER_MINUTE)) + 0.5))


def html_escape(value: Column) -> Column:
    """Escapes & < > and the double quote; null becomes ''."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def post_id(hash_: Column) -> Column:
    """The number in '#post-<digits>', null if there is none or it is no long."""
    return F.nullif(F.regexp_extract(hash_, r"^#post-(\d+)$", 1), F.lit("")).try_cast("long")


def fragment(href: Column) -> Column:
    """What follows the first '#', up to the next; null without one."""
    return F.try_element_at(F.split(href, "#"), F.lit(2))


def blank_cell(value: Column) -> Column:
    """Null, '' and a single space show as a non-breaking space; anything else stays, untrimmed."""
    return F.when(value.isNull() | value.isin("", " "), F.lit("&nbsp;")).otherwise(value)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n != 1, F.lit("s")).otherwise(F.lit("")))


def contains_folded(text: Column, query: str) -> Column:
    """Case-insensitive substring test; % and _ are plain characters."""
    return F.instr(F.lower(text), query.lower()) > 0


def highlight(text: Column, query: str) -> Column:
    """Wraps each case-insensitive hit of the query, taken literally, in <strong>."""
    literal = "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}-#&,~" else c for c in query)
    return F.regexp_replace(text, f"(?i)({literal})", "<strong>$1</strong>") if query else text


def opposite(player: Column) -> Column:
    """O for X, X for anything else."""
    return F.when(player == "X", "O").otherwise("X")


def encode_cell(i: Column, j: Column) -> Column:
    return i * 10 + j


def decode_cell(cell: Column) -> tuple[Column, Column]:
    return F.floor(cell / 10).cast("int"), (cell % 10).cast("int")


def tags_html(tags: Column, first: int | None = None) -> Column:
    """A span for each tag, all or the first few."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    shown = tags if first is None else F.slice(tags, 1, first)
    return F.array_join(F.transform(shown, lambda t: F.concat(F.lit('<span class="tag">'), html_escape(t), F.lit("</span>"))), "")


def is_post_hash(hash_: Column) -> Column:
    """Whether a fragment names a post: it starts with '#post-', whatever follows; null is none."""
    return F.coalesce(F.startswith(hash_, F.lit("#post-")), F.lit(False))
