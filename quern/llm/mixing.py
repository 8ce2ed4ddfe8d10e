"""Mixing sources to target weights: soft domain membership and fitted document rates."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.quality_rules import SPACE
from quern.llm.shared import stage

#: Hash buckets of words, and labelled rows that the classifier is fitted to at most.
BUCKETS, SAMPLE = 1 << 16, 20_000
#: Letters of a word's beginning.
PREFIX = 4
#: Deviations, in each of two folds, that make a bucket a feature, and features at most, those that deviate most.
SIGNIFICANT, FEATURES = 3.0, 512
#: Weight against large coefficients.
DECAY = 1.0
#: Newton steps at most for one solution, and the excess in shares of all tokens at which targets count as met.
ROUNDS, CLOSE = 60, 1e-9
#: Weight, against the targets, of staying near the last solution; solutions are repeated until targets are met or get no nearer.
RIDGE, REPEATS = 1e-2, 40
#: Excess in shares of all tokens above which mix() warns that the targets are out of reach.
MISSED = 1e-3


class Fit(NamedTuple):
    """Steps from rates of 1: for each, a number per domain; and the last excess in shares of all tokens."""

    steps: list[list[float]]
    excess: list[float]


class Model(NamedTuple):
    """What tells domains apart.

    place: for each bucket the number of its feature, from 1, or 0 if it has
    none. weights: a row per feature, then those of 1 and of a text's length,
    each with a number per domain. labelled: how many labelled texts each
    domain has; one without any is empty.
    """

    place: list[int]
    weights: list[list[float]]
    labelled: list[int]


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), "")


def _buckets(words: str, buckets: int) -> Column:
    """The buckets of a text's words and of how its words begin: inflected and compound words share their beginnings."""
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")
    return F.concat(F.transform(words, lambda w: bucket(w)), F.transform(words, lambda w: bucket(F.concat(F.lit(" "), F.left(w, F.lit(PREFIX))))))


def _table(values: Sequence, kind: str) -> Column:
    """A constant array, built once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _found(place: Sequence[int]) -> Column:
    """The numbers of the features that a text with the buckets _b has."""
    rows = _table(place, "array<int>")
    return F.array_distinct(F.filter(F.transform("_b", lambda b: F.get(rows, b)), lambda i: i > 0))


def _sum(weights: Sequence[float]) -> Column:
    """The weights of the features _f, summed."""
    table = _table(weights, "array<double>")
    return F.aggregate("_f", F.lit(0.0), lambda a, i: a + F.get(table, i))


def learn(features: Sequence[Sequence[int]], length: np.ndarray, domain: np.ndarray, size: int, domains: int, decay: float = DECAY, rounds: int = 2000) -> np.ndarray:
    """Multinomial logistic regression on the presence of features, 1 and a text's length: a row of weights per column.

    Weights are held by `decay`, that of 1 hardly. Steps are solved with an
    upper bound of the curvature, which holds for all weights, so each one
    lowers the loss.
    """
    n = len(features)
    x = np.zeros((n, size + 2))
    for i, found in enumerate(features):
        x[i, np.asarray(found, int) - 1] = 1
    x[:, size], x[:, size + 1] = 1, length
    y = np.zeros((n, domains))
    y[np.arange(n), domain] = 1
    hold = np.full((size + 2, 1), decay)
    hold[size] = 1e-3
    back = np.linalg.inv(x.T @ x / 2 + np.diag(hold[:, 0]))
    w = np.zeros((size + 2, domains))
    ahead, pace = w, 1.0
    for _ in range(rounds):
        score = x @ ahead
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - back @ (x.T @ (p - y) + hold * ahead)
        moved = np.abs(new - w).max(initial=0.0)
        if ((ahead - new) * (new - w)).sum() > 0:
            pace = 1.0  # momentum led astray
        quicker = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / quicker * (new - w), new, quicker
        if moved < 1e-7:
            break
    return w


def classifier(
    docs: DataFrame, labelled: DataFrame, domains: Sequence[str], sample: int = SAMPLE, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """A model of the words that a text has, however often, and of their beginnings, in hash buckets.

    It is fitted to the texts of at most `sample` rows of labelled (doc_id,
    domain), those with the smallest hash of their id; texts with the same
    words count once under a domain. The word with the smallest hash deals
    texts to two folds, so near copies are mostly in one. A bucket can be a
    feature if in both folds some domain has it SIGNIFICANT standard
    deviations more, or less, often than all do; so words that a few copied
    or long texts share by chance are none. A logistic regression, with the
    length as a further feature, then gives posteriors. At most `buckets` rows
    of counts and `sample` rows of FEATURES numbers come to the driver.
    """
    n = len(domains)
    known = labelled.select(F.col("doc_id").alias("_id"), F.col("domain").alias("_d")).where(F.col("_d").isin(list(domains)) & F.col("_id").isNotNull())
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_d").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_id"), _words(text).alias("_w")).join(F.broadcast(chosen), "_id")
    hashes = F.array_sort(F.array_distinct(F.transform("_w", lambda w: F.xxhash64(w))))
    own = F.array_sort(F.array_distinct(_buckets("_w", buckets)))
    texts = texts.select("_d", F.size("_w").cast("long").alias("tokens"), hashes.alias("_h"), own.alias("_b"))
    hashed = texts.groupBy("_d", "_h").agg(F.min("tokens").alias("tokens"), F.first("_b").alias("_b"))
    fold = F.pmod(F.xxhash64(F.coalesce(F.get("_h", F.lit(0)), F.lit(0).cast("long"))), F.lit(2)).cast("int")
    rows = stage(hashed.select("_d", "tokens", fold.alias("fold"), "_b"), "labelled")
    cells = [(f, k) for f in (0, 1) for k in range(n)]
    is_cell = [(F.col("fold") == f) & (F.col("_d") == domains[k]) for f, k in cells]
    got = rows.select("_d", "fold", F.explode("_b").alias("bucket")).groupBy("bucket").agg(*(F.count_if(c) for c in is_cell)).collect()
    of = {r["_d"]: r["count"] for r in rows.groupBy("_d").count().collect()}

    count = np.array([r[1:] for r in got], float).reshape(len(got), 2, n)
    total = count.sum(0)
    share = total / np.maximum(total.sum(1, keepdims=True), 1)
    expected = count.sum(2, keepdims=True) * share
    away = (count - expected) / np.sqrt(expected + 1)
    tells = ((away >= SIGNIFICANT).all(1) | (away <= -SIGNIFICANT).all(1)).any(1)
    least = np.maximum(away.min(1), -away.max(1)).max(1, initial=0.0)
    order = sorted((-a, r["bucket"]) for a, r, t in zip(least.tolist(), got, tells.tolist(), strict=True) if t)[:FEATURES]
    place = [0] * buckets
    for i, (_, b) in enumerate(order, 1):
        place[b] = i
    held = sorted(rows.select("_d", "tokens", F.sort_array(_found(place)).alias("f")).collect())
    size = [math.log1p(r["tokens"]) for r in held]
    weights = learn([r["f"] for r in held], np.array(size), np.array([domains.index(r["_d"]) for r in held], int), len(order), n)
    return Model(place, weights.tolist(), [of.get(d, 0) for d in domains])


def posteriors(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs as a struct column row, with tokens and p, the domain posteriors. Empty domains have none.

    One projection: a text's words are looked up in constant arrays where the
    text lies, so nothing is shuffled or joined.
    """
    n, buckets = len(model.labelled), len(model.place)
    row = F.struct(*docs.columns).alias("row")
    worded = docs.select(row, _words(text).alias("_w")).select("row", F.size("_w").cast("long").alias("tokens"), _buckets("_w", buckets).alias("_b"))
    found = worded.select("row", "tokens", _found(model.place).alias("_f"))
    full = [k for k in range(n) if model.labelled[k]] or list(range(n))
    *each, one, size = model.weights
    linear = []
    for k in full:
        start = F.lit(one[k]) + F.lit(size[k]) * F.log1p(F.col("tokens").cast("double"))
        linear.append((start + _sum([0.0, *(row[k] for row in each)])).alias(f"_z{k}"))
    scored = found.select("row", "tokens", *linear)
    top = F.greatest(*(f"_z{k}" for k in full)) if len(full) > 1 else F.col(f"_z{full[0]}")
    scored = scored.select("row", "tokens", *(F.exp(F.col(f"_z{k}") - top).alias(f"_e{k}") for k in full))
    whole = sum((F.col(f"_e{k}") for k in full), F.lit(0.0))
    return scored.select("row", "tokens", F.array(*(F.col(f"_e{k}") / whole if k in full else F.lit(0.0) for k in range(n))).alias("p"))


def _dot(p: str, h: Sequence[float] | Column, n: int) -> Column:
    total = F.lit(0.0)
    for k in range(n):
        total = total + F.get(p, F.lit(k)) * (F.get(h, F.lit(k)) if isinstance(h, Column) else F.lit(float(h[k])))
    return total


def rate(steps: Sequence[Sequence[float]], domains: int, p: str = "p") -> Column:
    """A document's rate: its steps from 1, each projected to zero or more."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*(F.array(*(F.lit(float(x)) for x in h)) for h in steps))
    return F.aggregate(table, F.lit(1.0), lambda r, h: F.greatest(F.lit(0.0), r - _dot(p, h, domains)))


def fit(scored: DataFrame, targets: Sequence[float]) -> Fit:
    """Least squares for rates r >= 0: sum of r * tokens * p_k at target_k of all tokens.

    Of all rates that meet the targets these are nearest to 1, weighed by
    tokens: r = max(0, 1 - p * h), with a number h_k per domain. h minimises a
    convex function whose gradient is minus the excess; RIDGE times the tokens
    of a domain holds h near where it was, first 0, which makes the function
    strongly convex, so that Newton steps, halved until they gain enough,
    converge. From each solution the next one is sought; targets within reach
    are met so, the excess falling by a factor each time. Where it falls by
    less than a fiftieth, targets are out of reach and the rates of least excess
    so far, which are still near 1, stand. Each pass reads tokens and
    posteriors and brings back some numbers per pair of domains.
    """
    n = len(targets)
    mass = scored.agg(*(F.sum(F.col("tokens") * F.get("p", F.lit(k))).alias(f"m{k}") for k in range(n)), F.sum("tokens").alias("t")).first()
    now, total = np.array([float(mass[k] or 0.0) for k in range(n)]), float(mass["t"] or 0.0)
    if not total:
        return Fit([], [0.0] * n)
    aim = np.array(targets, float) * total
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    p = [F.get("p", F.lit(k)) for k in range(n)]
    hold = RIDGE * now + 1e-9 * total

    def measure(h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The function at h without its ridge, its curvature, and the tokens of each domain."""
        rated = scored.select(rate([h.tolist()], n).alias("r"), "tokens", "p")
        left = F.when(F.col("r") > 0, F.col("tokens")).otherwise(F.lit(0))
        got = rated.agg(
            F.sum(F.col("r") * F.col("r") * F.col("tokens")), *(F.sum(F.col("r") * F.col("tokens") * x) for x in p), *(F.sum(left * p[i] * p[j]) for i, j in pairs)
        ).first()
        curve = np.zeros((n, n))
        for (i, j), x in zip(pairs, got[n + 1 :], strict=True):
            curve[i, j] = curve[j, i] = float(x)
        return float(got[0]) / 2 + aim @ h, curve, np.array(got[1 : n + 1], float)

    def missed(sums: np.ndarray) -> float:
        return float(np.abs(sums - aim)[now > 0].max(initial=0.0))

    h = np.zeros(n)
    at = measure(h)
    best, least = (h, at[2]), missed(at[2])
    for _ in range(REPEATS):
        base = h
        for _ in range(ROUNDS):
            g = np.where(now > 0, aim - at[2] + hold * (h - base), 0.0)
            if np.abs(g).max() <= max(CLOSE * total, 1e-3 * least) / 10:
                break
            step, share = -np.linalg.solve(at[1] + np.diag(hold), g), 1.0
            value = at[0] + hold @ (h - base) ** 2 / 2
            while True:
                tried = h + share * step
                new = measure(tried)
                if new[0] + hold @ (tried - base) ** 2 / 2 <= value + 1e-4 * share * (g @ step) + 1e-13 * abs(value) or share < 1e-9:
                    break
                share /= 2
            h, at = tried, new
        miss = missed(at[2])
        gained = miss < 0.98 * least
        if miss < least:
            best, least = (h, at[2]), miss
        if least <= CLOSE * total or not gained:
            break
    return Fit([best[0].tolist()], ((best[1] - aim) / total).tolist())


def wanted(targets: Mapping[str, float], model: Model) -> list[float]:
    """The targets in order of domain name; those of empty domains go to the others in proportion."""
    domains = sorted(targets)
    full = [bool(c) or not any(model.labelled) for c in model.labelled]
    left = sum(targets[d] for d, f in zip(domains, full, strict=True) if f)
    scale = sum(targets.values()) / left if left else 0.0
    return [float(targets[d]) * scale if f else 0.0 for d, f in zip(domains, full, strict=True)]


def _fitted(scored: DataFrame, targets: Mapping[str, float], model: Model) -> Fit:
    fitted = fit(scored, wanted(targets, model))
    if max(map(abs, fitted.excess), default=0.0) > MISSED:
        warnings.warn(f"targets out of reach, excess in shares of all tokens: {dict(zip(sorted(targets), fitted.excess, strict=True))}", stacklevel=3)
    return fitted


def _chanced(docs: DataFrame, model: Model, doc_id: str, text: str) -> DataFrame:
    """posteriors() with chance, a hash of id and text between 0 and 1."""
    # Fields are named through the struct, as docs may have columns of any name.
    said = F.xxhash64(F.col("row")[doc_id], F.coalesce(F.col("row")[text], F.lit("")), F.lit("copies"))
    return posteriors(docs, model, text).withColumn("chance", F.pmod(said, F.lit(1 << 30)) / float(1 << 30))


def _copied(chanced: DataFrame, model: Model, fitted: Fit) -> DataFrame:
    """Adds rate and copies, the rate rounded up or down by chance, so that it is right on average."""
    r = chanced.withColumn("rate", rate(fitted.steps, len(model.labelled)))
    return r.withColumn("copies", (F.floor("rate") + (F.col("chance") < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float],
    sample: int = SAMPLE,
    buckets: int = BUCKETS,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, source, tokens, p, rate, copies.

    labelled has doc_id and domain; targets give each domain's share of the
    tokens that docs have now. p are the posteriors in order of domain name.
    Rates are nonnegative; copies is the rate rounded to a whole number of
    copies. A domain that no labelled row of docs has is empty: its posteriors
    are 0 and its target goes to the others. Targets that no nonnegative rates
    meet are fitted by least squares, with a warning that gives the excess.

    Null text counts as empty: no tokens, the posteriors of a text without
    telling words. Labels of unknown or null domains or ids are not used;
    without any label all domains are alike. Repeated rows get equal rates;
    null ids and sources are kept; other columns are ignored; an empty table
    gives no rows. Texts are read once by the classifier, for the labelled
    rows, and once for all; only those of labelled rows are shuffled.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    model = classifier(d, labelled, sorted(targets), sample, buckets, "doc_id", "text")
    scored = stage(_chanced(d, model, "doc_id", "text").select("row.doc_id", "row.source", "tokens", "p", "chance"), "scored")
    return _copied(scored, model, _fitted(scored, targets, model)).drop("chance")


def resample(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], sample: int = SAMPLE, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs with each row as often as mix() says, none to several times; columns stay as they are. Rows are copied where they lie.

    Posteriors are formed twice, for the fit and beside each row, which is
    less work than to shuffle the rows to their rates.
    """
    model = classifier(docs, labelled, sorted(targets), sample, buckets, doc_id, text)
    fitted = _fitted(stage(posteriors(docs, model, text).select("tokens", "p"), "scored"), targets, model)
    # An outer explode: an inner one would have its array tested, and so computed, twice.
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return _copied(_chanced(docs, model, doc_id, text), model, fitted).select("row", F.explode_outer(times).alias("_nth")).where("_nth is not null").select("row.*")
