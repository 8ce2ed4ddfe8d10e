import html
import random
import string

from pyspark.sql import functions as F

from quern.functions import text as fx
from quern.operators import relational


def rows(seed, n=300):
    rng = random.Random(seed)
    alphabet = string.ascii_letters + " \n\t&<>\"'é#%_"
    return [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))), [rng.choice("abcdef") for _ in range(rng.randrange(5))]) for i in range(n)]


def frame(spark, seed):
    return spark.createDataFrame(rows(seed), "pos int, t string, tags array<string>").repartition(3)


def test_escape_is_reversible_and_leaves_safe_text_alone(spark):
    for r in frame(spark, 1).withColumn("e", fx.html_escape(F.col("t"))).collect():
        assert html.unescape(r.e) == r.t and not set(r.e) & set('<>"')
        if not set(r.t) & set('&<>"'):
            assert r.e == r.t


def test_read_time_is_at_least_one_and_monotone(spark):
    got = spark.range(0, 3000, 7).select("id", fx.read_minutes(F.col("id")).alias("m")).orderBy("id").collect()
    minutes = [r.m for r in got]
    assert minutes[0] == 1 and minutes == sorted(minutes) and minutes[-1] == round(got[-1].id / 220)


def test_head_and_tail_make_the_whole(spark):
    df = frame(spark, 2)
    both = relational.head(df, "pos").unionByName(relational.tail(df, "pos"))
    assert sorted(r.pos for r in both.collect()) == list(range(300))


def test_tag_counts_sum_to_the_sizes_and_ranks_are_a_permutation(spark):
    df = frame(spark, 3)
    got = relational.tag_counts(df, "pos").orderBy("rank").collect()
    assert sum(r.n for r in got) == sum(len(r.tags) for r in df.collect())
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and [r.n for r in got] == sorted((r.n for r in got), reverse=True)


def test_highlight_only_adds_marks(spark):
    for q in ("a", "e#", "%", "&<"):
        for r in frame(spark, 4).withColumn("h", fx.highlight(F.col("t"), q)).collect():
            assert r.h.replace("<strong>", "").replace("</strong>", "") == r.t
            assert r.h.count("<strong>") == r.t.lower().count(q)


def test_plan_reads_only_what_it_needs(spark):
    from quern.plans.reference import tag_filter

    plan = tag_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "text" not in schema.split("\n")[0] and "n_chars" not in schema.split("\n")[0]
