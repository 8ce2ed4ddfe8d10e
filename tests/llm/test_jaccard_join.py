import random

import numpy as np
from brute import jaccard_components

from quern.llm import jaccard_join, shingles
from quern.llm.jaccard_join import bands, segments


def check(spark, rows, schema="doc_id long, text string"):
    got = jaccard_join.join(spark.createDataFrame(rows, schema)).collect()
    want = jaccard_components([r[:2] for r in rows])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[i] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(i, f"more{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[i]
    return words


def family(rng, first, members, length, most):
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    return [(first + m, " ".join(edited(rng, base, rng.randrange(most + 1)))) for m in range(members)]


def test_bands_and_segments_cover_every_similar_pair():
    bounds = bands(85)
    number = segments(bounds, 85)
    for r in range(1, 400):
        for s in range(r, r * 100 // 85 + 1):
            i = -(-85 * (r + s) // 185)
            if i > r:
                continue
            k = np.searchsorted(bounds, [r, s], "right") - 1
            assert k[1] - k[0] in (0, 1)
            assert r + s - 2 * i < number[k[0]]


def test_same_as_all_pairs(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for length, members, most in ((30, 25, 3), (60, 20, 4), (120, 12, 8), (400, 8, 20), (12, 10, 1), (3, 4, 1), (2000, 3, 60)):
        rows += family(rng, n, members, length, most)
        n += members
    rng.shuffle(rows)
    check(spark, rows)


def test_chains_link_documents_that_are_not_similar_themselves(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for step in range(8):
        words[step * 12] = f"x{step}"
        rows.append((100 - step, " ".join(words)))
    check(spark, rows)


def test_edge_cases(spark):
    long_ = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three four"),
        (8, "One\x0btwo\x0cthree\rfour"), (9, "one two"), (10, "é É"), (11, "é É"), (11, "é É"), (None, "one two"), (None, None),
        (12, long_), (13, long_ + " end"), (13, long_ + " end"), (14, "other text"), (14, "one two"),
    ]
    check(spark, rows)
    check(spark, [(d, t, "a", "b") for d, t in rows], "doc_id long, text string, n long, node string".replace("n long", "n string"))


def test_empty_table(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "the same text that a third of all rows hold and more of it") for i in range(200)]
    rows += family(rng, 1000, 150, 40, 2)
    check(spark, rows)


def test_clusters_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    rng = random.Random(11)
    rows = family(rng, 0, 60, 50, 6) + family(rng, 100, 40, 80, 9)
    check(spark, rows)


def test_loud_signatures(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ONE_IN", 1)
    monkeypatch.setattr(jaccard_join, "LOUD", 1)
    monkeypatch.setattr(jaccard_join, "SPREAD", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    rng = random.Random(13)
    rows = family(rng, 0, 90, 40, 4) + family(rng, 100, 20, 300, 30) + [(200, "alone with its own words here"), (201, None)]
    check(spark, rows)


def test_words_hash_alike_wherever_they_lie(monkeypatch):
    text = "one Two three fourteen " * 40 + "x" * 500 + " one two"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = shingles.words(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(shingles, "CHUNK", 16)
    monkeypatch.setattr(shingles, "_powers", [])
    parts = shingles.words(data, np.array([0, len(data)]))[0]
    assert np.array_equal(whole, parts)
    assert whole[0] == whole[-2] and whole[1] == whole[-1] and len(set(whole.tolist())) == 5


def test_stages_stay_few(spark):
    """Each exchange keeps threads and plans in the driver for a while, whatever the size of the table."""
    rng = random.Random(17)
    rows = family(rng, 0, 60, 50, 6) + family(rng, 100, 40, 80, 9)
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextStageId()
    check(spark, rows)
    assert scheduler.nextStageId() - before <= 185


def test_ids_shared_by_rows_of_a_frequent_set(spark):
    rng = random.Random(19)
    same = "the same text that many rows hold and more of it"
    rows = [(i % 40, same) for i in range(90)] + [(5, None), (7, "other words of a row with this id")] + family(rng, 30, 30, 40, 2)
    check(spark, rows)
