import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quern.llm import exact_dedup, shared

SCHEMA = "doc_id long, text string, keep string"


def check(spark, rows, parts=6):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[t or ""].append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    got = exact_dedup.annotate(df).collect()
    assert len(got) == len(rows)
    kept = defaultdict(list)
    for r in got:
        t = sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
        if r.kept:
            kept[t].append(r.doc_id)
    assert kept == {t: [d] for t, d in best.items()}
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text or "") for r in out.collect()))) == sorted(map(repr, ((d, t) for t, d in best.items())))


def test_groups_ties_nulls_and_repeated_rows(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "z"), (3, None, "x"), (4, "", None), (None, "b", "x"), (None, "b", "x"), (None, "c", "x"), (5, "c", "x")]
    rows += [(6, "A", "x"), (7, "a ", "x"), (8, "é", "x"), (9, "é", "x"), (10, "long " * 100_000, "x"), (11, "long " * 100_000, "x")]
    check(spark, rows)


def test_hot_groups_are_settled_by_broadcast(spark):
    rows = [(i, "hot", "x") for i in range(3000)] + [(10_000 + i, f"rare {i % 2500}", "x") for i in range(5000)] + [(2999, "hot", "x")] * 3
    check(spark, rows, 40)
    digests = spark.createDataFrame(rows, SCHEMA).select(F.col("text").alias("k"))
    assert "hot" in {r.k for r in shared.among(digests, "k", shared.frequent(digests, "k")).collect()}
    assert shared.frequent(digests, "k").count() <= shared.WINNERS


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.annotate(df).count() == 0 and exact_dedup.dedup(df).count() == 0
