"""Operators on posts, tags and lookups, DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as fx

NO_TAGS = "cast(array() as array<string>)"


def first_match(df: DataFrame, condition: Column, pos: str) -> DataFrame:
    """The first row, in order of pos, that meets the condition."""
    return df.where(condition).orderBy(pos).limit(1)


def with_tag(df: DataFrame, tag: str | None, tags: str = "tags") -> DataFrame:
    """Rows with the tag; all rows for a null or empty tag. Null tags are none."""
    return df.where(F.array_contains(F.coalesce(F.col(tags), F.expr(NO_TAGS)), tag)) if tag else df


def with_class(df: DataFrame, selector: str, classes: str = "classes") -> DataFrame:
    """Rows with the class of a selector '.name'; '*' is all rows."""
    return df if selector == "*" else with_tag(df, selector.removeprefix("."), classes)


def tag_counts(df: DataFrame, pos: str, tags: str = "tags") -> DataFrame:
    """tag, n, rank: how often each tag occurs, repeats in a row included; ties keep the order of first appearance.

    Counts are formed before the shuffle; the ranking sorts one row per tag.
    """
    each = df.select(F.col(pos).alias("pos"), F.posexplode(tags).alias("tag_pos", "tag"))
    n = each.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct("pos", "tag_pos")).alias("first_seen"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first_seen"))
    return n.select("tag", "n", rank.cast("long").alias("rank"))


def head_flag(df: DataFrame, pos: str) -> DataFrame:
    """Adds is_featured: whether the row is the first in order of pos."""
    first = F.broadcast(df.agg(F.min(pos).alias("_first")))
    return df.crossJoin(first).withColumn("is_featured", F.col(pos) == F.col("_first")).drop("_first")


def head(df: DataFrame, pos: str) -> DataFrame:
    return df.orderBy(pos).limit(1)


def tail(df: DataFrame, pos: str) -> DataFrame:
    return head_flag(df, pos).where(~F.col("is_featured")).drop("is_featured")


def cards(df: DataFrame, first_tags: int | None = None) -> DataFrame:
    """Title, summary, date, read time and tags of posts; all tags or the first few."""
    words = fx.word_count(fx.strip_tags(F.col("content")))
    shown = F.coalesce(F.col("tags"), F.expr(NO_TAGS))
    shown = shown if first_tags is None else F.slice(shown, 1, first_tags)
    return df.select("pos", "id", "title", "summary", "date", fx.read_minutes(words).alias("read_min"), shown.alias("tags"))


def card_html(df: DataFrame, first_tags: int | None = None) -> DataFrame:
    """One HTML string for each post, everything escaped."""
    e = lambda c: fx.html_escape(F.col(c))
    c = cards(df, first_tags)
    html = F.concat(
        F.lit('<article data-id="'), e("id"), F.lit('"><h2>'), e("title"), F.lit("</h2><p>"), e("summary"), F.lit("</p><time>"), e("date"),
        F.lit("</time><small>"), F.col("read_min").cast("string"), F.lit(" min</small>"), fx.tags_html(F.col("tags")), F.lit("</article>"),
    )
    return c.select("pos", "id", html.alias("html"))


def count_label(df: DataFrame, noun: str = "post") -> DataFrame:
    """One row: n, and the label with the noun in the right number."""
    return df.agg(F.count("*").alias("n")).withColumn("label", fx.plural(F.col("n"), noun))


def route(df: DataFrame, hashes: DataFrame, hash_: str = "hash", id_: str = "id", pos: str = "pos") -> DataFrame:
    """For each hash the first post with its id; is_listing where there is none."""
    wanted = hashes.withColumn("_id", fx.post_id(F.col(hash_)))
    first = df.groupBy(F.col(id_).alias("_id")).agg(F.min(pos).alias("post_pos"))
    return wanted.join(first, "_id", "left").select(hash_, F.col("_id").alias("post_id"), "post_pos", F.col("post_pos").isNull().alias("is_listing"))


def interval_lookup(df: DataFrame, bands: DataFrame, value: str, top: str = "top", height: str = "height", name: str = "name") -> DataFrame:
    """Every band with top <= value < top + height. Whether bands are broadcast is left to the optimiser, which knows their size."""
    b = bands.select(F.col(name).alias("band"), F.col(top).alias("_lo"), (F.col(top) + F.col(height)).alias("_hi"))
    return df.join(b, (F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi"))).drop("_lo", "_hi")


def asof_lookup(df: DataFrame, offsets: Sequence[tuple[float, str]], value: str) -> DataFrame:
    """Adds target: that of the greatest offset not above the value, the last one given if offsets tie; null below all.

    offsets is a constant of the caller, searched in place: no join, no shuffle.
    """
    table = F.array(*(F.struct(F.lit(float(o)).alias("o"), F.lit(t).alias("t")) for o, t in sorted(offsets, key=lambda x: x[0])))
    hit = F.element_at(F.filter(table, lambda x: x["o"] <= F.col(value)), -1)
    found = F.when(F.exists(table, lambda x: x["o"] <= F.col(value)), hit["t"])
    return df.withColumn("target", found if offsets else F.lit(None).cast("string"))


def last_section(df: DataFrame, sections: Sequence[tuple[str, float]], value: str, threshold: float) -> DataFrame:
    """Adds section: the last one given, not the lowest, with position - threshold < value; null if there is none."""
    out = F.lit(None).cast("string")
    for name, position in sections:
        out = F.when(F.lit(float(position) - threshold) < F.col(value), F.lit(name)).otherwise(out)
    return df.withColumn("section", out)


def lookup(df: DataFrame, sections: DataFrame, href: str, key: str) -> DataFrame:
    """Joins each link with the section that its fragment names."""
    return df.withColumn("_f", fx.fragment(F.col(href))).join(sections, F.col("_f") == F.col(key)).drop("_f")


def default_matcher(text: Column, query: str) -> Column:
    return fx.contains_folded(text, query)


def default_sorter(text: Column, query: str) -> Column:
    """0 if the text begins with the query in any case, 1 if it has it in this case, else 2."""
    return F.when(F.instr(F.lower(text), query.lower()) == 1, 0).when(F.instr(text, query) > 0, 1).otherwise(2)


def typeahead(
    df: DataFrame | Callable[[str], DataFrame],
    query: str,
    text: str,
    order: str,
    items: int = 8,
    matcher: Callable[[Column, str], Column] = default_matcher,
    sorter: Callable[[Column, str], Column] = default_sorter,
    highlighter: Callable[[Column, str], Column] = fx.highlight,
) -> DataFrame:
    """The best `items` matches with html and rank, ties in the given order; nothing for an empty query.

    matcher, sorter and highlighter are Column functions and can be replaced.
    The source is a table, or a function that gives one for the query.
    """
    df = df(query) if callable(df) else df
    if not query:
        return df.limit(0).withColumn("html", F.lit("")).withColumn("rank", F.lit(0).cast("long"))
    hits = df.where(matcher(F.col(text), query)).withColumn("_class", sorter(F.col(text), query))
    top = hits.orderBy("_class", order).limit(items)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("_class", order)).cast("long"))
    return ranked.withColumn("html", highlighter(F.col(text), query)).drop("_class")


def weighted_difference(df: DataFrame, weights: DataFrame, keys: Sequence[str], on: Sequence[str], mine: Column, theirs: Column, weight: str = "w") -> DataFrame:
    """Per key the weights of own rows less those of the other side's."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0))
    return df.join(weights, list(on)).groupBy(*keys).agg((total(mine) - total(theirs)).alias("score"))


def best_of(df: DataFrame, keys: Sequence[str], score: str, tie: str, above: float | None = None) -> DataFrame:
    """Per key the row with the highest score, the smallest tie-breaker among equals, scores above a bound only.

    An aggregate, not a window: rows are reduced before the shuffle.
    """
    rows = df if above is None else df.where(F.col(score) > above)
    best = rows.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(tie).alias("_t"))).alias("_b"))
    return best.select(*keys, (-F.col("_b._s")).alias(score), F.col("_b._t").alias(tie))


def changed(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Per key whether any cell differs."""
    return df.groupBy(*keys).agg(F.bool_or(~F.col(before).eqNullSafe(F.col(after))).alias("changed"))


def state(df: DataFrame, empty: str = "no posts", some: str = "posts") -> DataFrame:
    """One row: which branch a page takes for df, and featured and others, the rows that its two parts show."""
    n = F.count("*")
    return df.agg(F.when(n == 0, empty).otherwise(some).alias("state"), F.least(n, F.lit(1)).alias("featured"), F.greatest(n - 1, F.lit(0)).alias("others"))


def merge_unique(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both, each once, by column name."""
    return a.unionByName(b).distinct()
