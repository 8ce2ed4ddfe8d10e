import math
import random
import re
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing as m
from quern.llm import queries
from quern.llm.shared import stage

SCHEMA = "doc_id long, text string, source string"
DATA = "/root/testdata/sf0.1"
LABEL = "doc_id long, domain string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def hashes(spark, texts):
    """xxhash64 of every word and word beginning."""
    every = sorted({x for t in texts for w in words(t) for x in (w, " " + w[: m.PREFIX])})
    return {r.w: r.h for r in spark.createDataFrame([(x,) for x in every] or [("x",)], "w string").withColumn("h", F.xxhash64("w")).collect()}


def brute_model(spark, docs, labels, domains):
    """Features and a logistic regression by plain gradient descent: feature numbers by bucket, weights, labelled texts."""
    h = hashes(spark, [t for _, t, _ in docs])
    buckets = lambda t: {h[x] % m.BUCKETS for w in words(t) for x in (w, " " + w[: m.PREFIX])}
    once = {}
    for i, d in labels:
        for k, t, _ in docs:
            if i is not None and k == i and d in domains:
                key = (d, frozenset(words(t)))
                once[key] = min(once.get(key, (10**9,))[0], len(words(t))), t
    least = [min((h[w] for w in words(t)), default=0) for _, t in once.values()]
    folded = {r.v: r.f for r in spark.createDataFrame([(x,) for x in set(least)], "v long").withColumn("f", F.pmod(F.xxhash64("v"), F.lit(2))).collect()} if least else {}
    fold = [folded[x] for x in least]
    count = {}
    for f, ((d, _), (_, t)) in zip(fold, once.items(), strict=True):
        for b in buckets(t):
            count.setdefault(b, np.zeros((2, len(domains))))[f, domains.index(d)] += 1
    total = sum(count.values())
    strength = []
    for b, c in count.items():
        e = np.array([c[f].sum() * total[f] / max(total[f].sum(), 1) for f in (0, 1)])
        z = (c - e) / np.sqrt(e + 1)
        s = max(max(z[:, k].min(), -z[:, k].max()) for k in range(len(domains)))
        if s >= m.SIGNIFICANT:
            strength.append((-s, b))
    place = {b: i for i, (_, b) in enumerate(sorted(strength)[: m.FEATURES])}
    x = np.zeros((len(once), len(place) + 2))
    y = np.zeros((len(once), len(domains)))
    for i, ((d, _), (n, t)) in enumerate(once.items()):
        x[i, [place[b] for b in buckets(t) if b in place]] = 1
        x[i, -2:] = 1, math.log1p(n)
        y[i, domains.index(d)] = 1
    w = np.zeros((x.shape[1], len(domains)))
    hold = np.full((x.shape[1], 1), m.DECAY)
    hold[-2] = 1e-3
    pace = 1 / (np.linalg.eigvalsh(x.T @ x).max() / 2 + m.DECAY)
    for _ in range(60_000):
        w -= pace * (x.T @ (softmax(x @ w) - y) + hold * w)
    return place, w, Counter(d for d, _ in once), buckets


def rows_of(seed):
    rng = random.Random(seed)
    fruit, metal, plain = "apple pear plum cherry".split(), "iron steelworks nail steelmill".split(), "the of and some other words are here in every text".split()
    docs, labels = [], []
    for i in range(400):
        kind = i % 3 == 0
        text = [rng.choice(plain) for _ in range(rng.randrange(3, 40))] + [rng.choice(metal if kind else fruit) for _ in range(rng.choice([1, 2, 5, 9]))]
        rng.shuffle(text)
        text += [f"n{i}x{k}" for k in range(20)]  # so that the least hash deals texts evenly
        docs.append((i, " ".join(text), "a"))
        if i < 360:
            labels.append((i, "metal" if kind else "fruit"))
    docs += [(500, "apple iron", "c"), (501, None, None), (502, "", "a"), (None, "pear pear", "a"), (503, "unknown", "c"), (5, "Apple\tIRON\n" * 3000, "a"), docs[7]]
    return docs, labels + [(None, "metal"), (7, None), (8, "other"), (999, "fruit"), (501, "fruit")]


DOCS, LABELS = rows_of(2)


def tables(spark, docs=DOCS, labels=LABELS):
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABEL)


def shares(mixed, n):
    total, *sums = mixed.agg(F.sum("tokens"), *(F.sum(F.col("rate") * F.col("tokens") * F.get("p", F.lit(k))) for k in range(n))).first()
    return [s / total for s in sums]


def test_same_as_brute_force(spark):
    domains, targets = ["fruit", "metal"], {"fruit": 0.45, "metal": 0.55}
    place, w, labelled, buckets = brute_model(spark, DOCS, LABELS, domains)
    model = m.classifier(*tables(spark), domains)
    assert {b: i - 1 for b, i in enumerate(model.place) if i} == place and len(place) >= 2
    assert model.labelled == [labelled[d] for d in domains]
    got = sorted(m.mix(*tables(spark), targets).collect(), key=lambda r: (repr(r.doc_id), r.tokens))
    for g, (d, t, _) in zip(got, sorted(DOCS, key=lambda r: (repr(r[0]), len(words(r[1])))), strict=True):
        x = np.zeros(len(place) + 2)
        x[[place[b] for b in buckets(t) if b in place]] = 1
        x[-2:] = 1, math.log1p(len(words(t)))
        assert (g.doc_id, g.tokens) == (d, len(words(t)))
        assert list(g.p) == pytest.approx(softmax(x @ w).tolist(), abs=1e-3)
        assert g.rate >= 0 and g.copies in (math.floor(g.rate), math.floor(g.rate) + 1)


def test_rates_meet_targets_and_are_nearest_to_one(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.2, 0.2], 400)
    tokens = rng.integers(0, 500, 400)
    df = stage(spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, p array<double>"), "test")
    for targets in ([0.8, 0.1, 0.1], [0.05, 0.05, 0.9], [1.5, 0.2, 0.05]):
        fitted = m.fit(df, targets)
        # For a convex problem this form and the totals say that no other rates that meet the targets are nearer to 1.
        rates = np.maximum(0, 1 - p @ np.array(fitted.steps[0]))
        assert ((rates * tokens) @ p / tokens.sum()).tolist() == pytest.approx(targets, abs=1e-6)


def test_targets_out_of_reach_leave_least_squares(spark):
    rows = [(10, [0.9, 0.1]), (30, [0.4, 0.6]), (20, [0.6, 0.4])]
    t, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    fitted = m.fit(spark.createDataFrame(rows, "tokens long, p array<double>"), [0.0, 1.0])
    r, now = np.ones(3), t @ p
    for _ in range(20_000):  # projected gradient
        r = np.maximum(0, r - 0.1 * (p @ (((r * t) @ p - [0, 60]) / now)))
    squares = lambda e: (np.square(e) / now).sum()
    best, got = squares((r * t) @ p - [0, 60]), squares(np.array(fitted.excess) * 60)
    assert best - 1e-6 <= got <= 1.25 * best
    assert np.maximum(0, 1 - p @ np.array(fitted.steps[0])).max() < 5


def test_production_targets_are_met(spark):
    mixed = m.mix(spark.read.parquet(f"{DATA}/documents.parquet"), queries.labelled(spark, DATA), queries.TARGETS).cache()
    assert shares(mixed, 3) == pytest.approx([queries.TARGETS[d] for d in sorted(queries.TARGETS)], abs=1e-5)
    # Clean documents stay.
    labelled = mixed.join(queries.labelled(spark, DATA).where("domain = 'clean'"), "doc_id")
    assert labelled.where("copies = 0").count() < 0.02 * labelled.count()


def test_held_out_domains(spark):
    labels = queries.labelled(spark, DATA)
    held = labels.where("doc_id % 4 = 0")
    mixed = m.mix(spark.read.parquet(f"{DATA}/documents.parquet"), labels.where("doc_id % 4 <> 0"), queries.TARGETS)
    got = mixed.join(held, "doc_id").select("domain", "p", "tokens", "rate").toPandas()
    p = np.array(got.p.tolist())
    truth = np.array([sorted(queries.TARGETS).index(d) for d in got.domain])
    assert (p.argmax(1) == truth).mean() > 0.9
    # Calibrated, for short and for long texts alike.
    for part in (got.tokens < 200, got.tokens >= 200):
        assert np.abs(p[part].mean(0) - np.eye(3)[truth[part]].mean(0)).max() < 0.06
    assert got[got.domain == "toxic"].rate.mean() < 0.4 and got[got.domain == "clean"].rate.mean() > 0.9


def test_an_empty_domain_leaves_its_target_to_the_others(spark):
    docs, labels = tables(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mixed = m.mix(docs, labels, {"fruit": 0.4, "metal": 0.4, "wood": 0.2})
    assert shares(mixed, 3) == pytest.approx([0.5, 0.5, 0.0], abs=1e-5)
    with pytest.warns(UserWarning, match="out of reach"):
        m.mix(docs, labels, {"fruit": 0.0, "metal": 1.0})


def test_resample_repeats_rows_and_keeps_columns(spark):
    docs = spark.createDataFrame([(*d, "k", 1) for d in DOCS], SCHEMA + ", key string, copies int")
    labels = spark.createDataFrame(LABELS, LABEL)
    targets = {"fruit": 0.9, "metal": 1.6}
    want = Counter()
    for r in m.mix(docs, labels, targets).collect():
        want[r.doc_id] += r.copies
    out = m.resample(docs, labels, targets)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], LABEL)
    assert m.mix(none, labels, {"a": 1.0}).count() == 0
    got = m.mix(spark.createDataFrame(DOCS, SCHEMA), labels, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == len(DOCS) and all(list(r.p) == pytest.approx([0.5, 0.5]) and r.rate == pytest.approx(1) for r in got)
    assert m.wanted({"a": 0.5, "b": 0.5}, m.Model([], [], [0, 0])) == [0.5, 0.5]
