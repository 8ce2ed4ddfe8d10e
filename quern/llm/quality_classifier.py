"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.quality_rules import STOP_WORDS
from quern.llm.shared import stage
from quern.llm.shingles import chunks, hashed, mix, spans

ABSTAIN, GOOD, BAD = 0, 1, 2
#: Weights of the scorer, documents that it is trained on at most, and the least score of a kept document.
BUCKETS, SAMPLE, LEAST = 1 << 16, 8192, 0.4
#: Bytes of features that the scorer is trained on, at most; the driver holds them.
SAMPLE_BYTES = 64 << 20


class Labeller(NamedTuple):
    """Votes bad below `bad` and good from `good` on, or the other way round if bad > good; else it abstains."""

    measure: str
    bad: float
    good: float


#: The share of letters, symbols and so on is that of bytes or words, as named.
LABELLERS = (
    Labeller("words", 15, 60),
    Labeller("symbols_a_word", 0.25, 0.05),
    Labeller("marks_a_word", 0.4, 0.05),
    Labeller("stop_share", 0.04, 0.12),
    Labeller("upper_share", 0.4, 0.15),
    Labeller("distinct_share", 0.25, 0.45),
    Labeller("letter_share", 0.6, 0.75),
    Labeller("repeated_neighbours", 0.2, 0.05),
)

_BYTES = np.arange(256)
_SYMBOL = np.isin(_BYTES, [ord(c) for c in "#*$%&|<>"])
_MARK = np.isin(_BYTES, [ord(c) for c in "!?"])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def _hash_of(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, _ = spans(data, bounds)
    return hashed(data, starts, ends)


_STOPS = np.sort(_hash_of(sorted(set(STOP_WORDS))))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]


class Texts(NamedTuple):
    """Words of a run of texts: bytes, bounds, first and last bytes, hashes, and where each text's words begin."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    at: np.ndarray


def _texts(batch, column: int) -> Iterator[tuple[int, int, Texts]]:
    for first, rows, data, bounds in chunks(batch, column):
        starts, ends, at = spans(data, bounds)
        yield first, rows, Texts(data, bounds, starts, ends, hashed(data, starts, ends), at)


def _repeats(t: Texts) -> np.ndarray:
    """Whether each word equals the one before it."""
    same = np.zeros(len(t.words), bool)
    same[1:] = t.words[1:] == t.words[:-1]
    same[t.at[:-1][np.diff(t.at) > 0]] = False
    return same


def measures(t: Texts) -> dict[str, np.ndarray]:
    n = np.diff(t.at)
    one = np.maximum(n, 1)
    size = np.maximum(np.diff(t.bounds), 1)
    letters = _sums(_LETTER[t.data], t.bounds)
    same = _repeats(t)
    distinct = np.array([len(np.unique(t.words[a:b])) for a, b in zip(t.at[:-1], t.at[1:], strict=True)])
    where = np.minimum(np.searchsorted(_STOPS, t.words), len(_STOPS) - 1)
    return {
        "words": n.astype(float),
        "symbols_a_word": _sums(_SYMBOL[t.data], t.bounds) / one,
        "marks_a_word": _sums(_MARK[t.data], t.bounds) / one,
        "stop_share": _sums(_STOPS[where] == t.words, t.at) / one,
        "upper_share": _sums(_UPPER[t.data], t.bounds) / np.maximum(letters, 1),
        # Long texts repeat words by nature: their share is measured against what a text of that length has.
        "distinct_share": distinct / one * np.maximum(1, np.sqrt(n / 200)),
        "letter_share": letters / size,
        "repeated_neighbours": _sums(same, t.at) / one,
    }


def patterns(t: Texts, labellers=LABELLERS) -> np.ndarray:
    """The votes of all labellers on each text as one number in base 3."""
    m, out = measures(t), np.zeros(len(t.at) - 1, np.int64)
    for x in labellers:
        v = m[x.measure]
        bad, good = (v < x.bad, v >= x.good) if x.bad < x.good else (v >= x.bad, v < x.good)
        out = out * 3 + np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))
    return out


def votes_of(pattern: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([pattern // 3**k % 3 for k in range(labellers - 1, -1, -1)], axis=1)


def posteriors(pattern: np.ndarray, count: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each vote pattern, and each labeller's vote rates given the class, by expectation-maximisation.

    Labellers are taken as independent given the class. At the start a vote
    for bad outweighs those of all others for good, as each kind of junk has
    few labellers that see it.
    """
    votes = votes_of(pattern, labellers)
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    p = (good + 1) / (good + labellers * bad + 2)
    rates = np.zeros((2, labellers, 3))
    for _ in range(rounds):
        weight = np.stack([p * count, (1 - p) * count])
        for v in range(3):
            rates[:, :, v] = weight @ (votes == v) + 0.5
        rates /= rates.sum(2, keepdims=True)
        prior = (weight.sum(1) + 1) / (count.sum() + 2)
        logs = np.log(rates)[:, np.arange(labellers), votes].sum(2) + np.log(prior)[:, None]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        done = np.max(np.abs(new - p), initial=0) < 1e-7
        p = new
        if done:
            break
    return p, rates


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of a text's features, and where each text's begin.

    For each word: itself, its last two bytes, its first, and whether it
    repeats the word before.
    """
    data = t.data.astype(np.uint64)
    tail = data[t.ends] * np.uint64(256) + data[np.maximum(t.ends - 1, t.starts)]
    every = np.stack([t.words, mix(tail, 11), mix(data[t.starts], 12), mix(_repeats(t).astype(np.uint64), 13)], axis=1)
    every = every if len(t.words) else np.zeros((0, 4), np.uint64)
    return (every & np.uint64(BUCKETS - 1)).astype(np.int64).ravel(), 4 * t.at


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression on mean hashed features with soft targets; the last weight is the intercept."""
    weights = np.zeros(BUCKETS + 1)
    if not len(target):
        return weights
    of = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    bucket, value = (np.concatenate(x) for x in zip(*rows, strict=True))
    squares = np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(of, weights[bucket] * value, len(rows)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(bucket, error[of] * value, BUCKETS), error.sum()) / len(rows) + decay * weights
        squares += g * g
        weights -= 0.5 * g / np.sqrt(squares)
    return weights


def score(t: Texts, weights: np.ndarray) -> np.ndarray:
    bucket, at = features(t)
    z = _sums(weights[bucket], at) / np.maximum(np.diff(at), 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _label(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, rows, t in _texts(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), pa.array(patterns(t))], ["doc_id", "pattern"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern long")


def _sampled(docs: DataFrame, sample: int, most: int) -> list[tuple]:
    """Pattern, feature buckets and values of at most `sample` documents, those with the smallest hash of their text.

    In that order, a document whose features would make them more than `most`
    bytes is passed over.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, rows, t in _texts(b, 1):
                bucket, at = features(t)
                x, y = [], []
                for k in range(rows):
                    own = np.unique(bucket[at[k] : at[k + 1]], return_counts=True)
                    x.append(own[0].astype(np.int32).tobytes())
                    y.append((own[1] / max(at[k + 1] - at[k], 1)).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, rows), pa.array(patterns(t)), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["_k", "pattern", "x", "y"]
                )

    # Only hashes are sorted; the texts of the chosen ones are read again.
    key = F.xxhash64("_t")
    chosen = docs.select(key.alias("_k")).distinct().orderBy("_k").limit(sample)
    rows = docs.select(key.alias("_k"), "_t").join(F.broadcast(chosen), "_k")
    # Copies of a text count once.
    rows = stage(rows.mapInArrow(run, "_k long, pattern long, x binary, y binary").dropDuplicates(["_k"]), "sample")
    taken, total = [], 0
    for k, size in sorted(map(tuple, rows.select("_k", F.length("x") + F.length("y")).collect())):
        if total + size <= most:
            taken.append((k,))
            total += size
    wanted = docs.sparkSession.createDataFrame(taken, "_k long")
    return rows.join(F.broadcast(wanted), "_k", "left_semi").select("pattern", "x", "y").collect()


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[dict[int, float], np.ndarray]:
    """P(good) by vote pattern, and the scorer's weights. docs: doc_id and _t, the text."""
    counted = sorted(_label(docs).groupBy("pattern").count().collect())  # 3 ** labellers rows at most
    pattern = np.array([r[0] for r in counted], np.int64)
    p, _ = posteriors(pattern, np.array([r[1] for r in counted], float), len(LABELLERS))
    known = dict(zip(pattern.tolist(), p.tolist(), strict=True))
    rows = sorted(_sampled(docs, sample, most))
    target = np.array([known[r["pattern"]] for r in rows])
    return known, train([(np.frombuffer(r["x"], np.int32), np.frombuffer(r["y"], np.float32).astype(float)) for r in rows], target)


def classify(docs: DataFrame, least: float = LEAST, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, posterior of the label model, score of the scorer, kept.

    The label model is fitted to the votes on all documents, through the
    counts of vote patterns. The scorer is trained on at most `sample`
    distinct texts, whose features take at most `most` bytes. Null text counts as empty: its score is the intercept's.
    Repeated rows get equal results; null ids and other columns change
    nothing; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    known, weights = fit(rows, sample, most)
    weights = weights.astype(np.float32)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, n, t in _texts(b, 1):
                s = score(t, weights)
                p = [known[k] for k in patterns(t).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), pa.array(p, pa.float64()), pa.array(s), pa.array(s >= least)], ["doc_id", "posterior", "score", "kept"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"doc_id {kind}, posterior double, score double, kept boolean"), "scores")
