from pyspark.sql import functions as F

from quern.functions import text as fx
from quern.operators import forms, relational


def values(spark, expr, rows, schema="c string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr(F.col("c"))).collect()]


def test_reading_time(spark):
    texts = ["w " * n for n in (0, 1, 329, 330, 549, 550)] + [None, "<p>" + "w " * 330 + "</p>"]
    words = lambda c: fx.word_count(fx.strip_tags(c))
    assert values(spark, words, [(t,) for t in texts]) == [1, 1, 329, 330, 549, 550, 1, 330]
    assert values(spark, lambda c: fx.read_minutes(words(c)), [(t,) for t in texts]) == [1, 1, 1, 2, 2, 3, 1, 2]


def test_escape_and_blank(spark):
    assert values(spark, fx.html_escape, [("<a href=\"x\">&amp;'",), (None,), ("plain",)]) == ["&lt;a href=&quot;x&quot;&gt;&amp;amp;'", "", "plain"]
    assert values(spark, fx.blank_cell, [(None,), ("",), (" ",), ("  ",), (" a",)]) == ["&nbsp;"] * 3 + ["  ", " a"]


def test_routes(spark):
    assert values(spark, fx.post_id, [("#post-7",), ("#post-7x",), ("#top",), (None,), ("#post-99999999999999999999",)]) == [7, None, None, None, None]
    assert values(spark, fx.fragment, [("a#b#c",), ("a",), ("#x",)]) == ["b", None, "x"]


def test_highlight_takes_the_query_literally(spark):
    assert values(spark, lambda c: fx.highlight(c, "a.B"), [("xA.bx a.b axb",)]) == ["x<strong>A.b</strong>x <strong>a.b</strong> axb"]
    assert values(spark, lambda c: fx.highlight(c, "$1\\"), [("cost $1\\",)]) == ["cost <strong>$1\\</strong>"]


def posts(spark):
    rows = [(0, 5, ["b", "a", "b"]), (1, 6, None), (2, 7, ["c", "a"]), (3, 5, [])]
    return spark.createDataFrame(rows, "pos int, id int, tags array<string>")


def test_tags_count_repeats_and_ties_keep_first_appearance(spark):
    got = relational.tag_counts(posts(spark), "pos").orderBy("rank").collect()
    assert [(r.tag, r.n) for r in got] == [("b", 2), ("a", 2), ("c", 1)]


def test_filters_and_head(spark):
    p = posts(spark)
    ids = lambda df: sorted(r.pos for r in df.collect())
    assert ids(relational.with_tag(p, "a")) == [0, 2] and ids(relational.with_tag(p, "")) == ids(relational.with_tag(p, None)) == [0, 1, 2, 3]
    assert ids(relational.with_class(p, "*", "tags")) == [0, 1, 2, 3] and ids(relational.with_class(p, ".c", "tags")) == [2]
    assert ids(relational.head(p, "pos")) == [0] and ids(relational.tail(p, "pos")) == [1, 2, 3]
    assert relational.first_match(p, F.col("id") == 5, "pos").collect()[0].pos == 0
    assert relational.count_label(p.limit(1)).collect()[0].label == "1 post"
    assert relational.head_flag(p.limit(0), "pos").count() == 0


def test_lookups(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.5, 5.0, 10.0)], "y double")
    got = {r.y: r.target for r in relational.asof_lookup(df, [(0.0, "a"), (5.0, "b"), (5.0, "c")], "y").collect()}
    assert got == {-1.0: None, 0.0: "a", 4.5: "a", 5.0: "c", 10.0: "c"}
    bands = spark.createDataFrame([("x", 0.0, 5.0), ("y", 4.0, 2.0)], "name string, top double, height double")
    assert sorted((r.y, r.band) for r in relational.interval_lookup(df, bands, "y").collect()) == [(0.0, "x"), (4.5, "x"), (4.5, "y"), (5.0, "y")]
    got = {r.y: r.section for r in relational.last_section(df, [("p", 5.0), ("q", 1.0)], "y", 0.5).collect()}
    assert got == {-1.0: None, 0.0: None, 4.5: "q", 5.0: "q", 10.0: "q"}


def test_typeahead_order_and_limits(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["xRe", "are", "red", "RE", "no", "100%"])], "k int, t string")
    got = relational.typeahead(df, "re", "t", "k").orderBy("rank").collect()
    assert [r.t for r in got] == ["red", "RE", "are", "xRe"] and got[0].html == "<strong>re</strong>d"
    assert relational.typeahead(df, "", "t", "k").count() == 0
    assert [r.t for r in relational.typeahead(df, "%", "t", "k").collect()] == ["100%"]
    assert relational.typeahead(df, "e", "t", "k", items=2).count() == 2
    last = relational.typeahead(df, "re", "t", "k", sorter=lambda c, q: -F.col("k")).orderBy("rank").collect()
    assert [r.k for r in last] == [3, 2, 1, 0]


def test_best_takes_the_smallest_among_equals(spark):
    df = spark.createDataFrame([("a", 3, 9), ("a", 3, 4), ("a", 1, 1), ("b", -20, 1), ("c", None, 1)], "k string, s int, t int")
    assert [tuple(r) for r in relational.best_of(df, ["k"], "s", "t", above=-10).collect()] == [("a", 3, 4)]
    same = spark.createDataFrame([(1, "x", "x"), (1, None, None), (2, "x", "y"), (2, "x", "x")], "k int, b string, a string")
    assert dict(map(tuple, relational.changed(same, ["k"], "b", "a").collect())) == {1: False, 2: True}


def test_forms(spark):
    rows = [("a@b.c", "5", "2020-02-29"), ("a@b", "x", "2019-02-29"), (None, None, None), ("a b@c", "1e3", "1.1.2020")]
    df = spark.createDataFrame(rows, "e string, n string, d string")
    got = forms.check(df, {"e": forms.is_email(F.col("e")), "n": forms.is_number(F.col("n")), "d": forms.is_date(F.col("d")), "r": forms.required(F.col("e"))})
    assert [(r.errors, r.valid) for r in got.collect()] == [("", True), ("n,d", False), ("r", False), ("e,d", False)]
