import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import quality_classifier as q

DATA = "/root/testdata/sf0.01"


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(5)
    n, accuracy = 40_000, np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    truth = rng.random(n) < 0.7
    votes = np.where(rng.random((n, 5)) < accuracy, truth[:, None], ~truth[:, None])
    coded = np.where(rng.random((n, 5)) < 0.2, q.ABSTAIN, np.where(votes, q.GOOD, q.BAD))
    pattern, count = np.unique(coded @ 3 ** np.arange(4, -1, -1), return_counts=True)
    assert (q.votes_of(pattern, 5) @ 3 ** np.arange(4, -1, -1) == pattern).all()
    p, rates = q.posteriors(pattern, count.astype(float), 5)
    got = rates[0, :, q.GOOD] / (rates[0, :, q.GOOD] + rates[0, :, q.BAD])
    assert np.abs(got - accuracy).max() < 0.03
    called = dict(zip(pattern, p > 0.5, strict=True))
    right = np.mean([called[x] == t for x, t in zip(coded @ 3 ** np.arange(4, -1, -1), truth, strict=True)])
    assert right > 0.93


def test_measures_match_plain_python():
    texts = ["The of AND xx!! 3# the", "", "a a A b", "é " * 9, "one\n\ttwo"]
    ((_, n, t),) = q._texts(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0)
    m = q.measures(t)
    assert n == 5 and m["words"].tolist() == [6, 0, 4, 9, 2]
    assert m["stop_share"][0] == 4 / 6 and m["marks_a_word"][0] == 2 / 6 and m["symbols_a_word"][0] == 1 / 6
    assert m["repeated_neighbours"].tolist() == [0, 0, 2 / 4, 8 / 9, 0]
    assert m["upper_share"][0] == 4 / 13 and m["distinct_share"][2] == 2 / 4


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")  # not used in training
    got = q.classify(docs).join(labels, "doc_id").join(docs.select("doc_id", F.length("text").alias("size")), "doc_id")
    good = got.where("quality = 1 and size > 100")
    assert good.where("kept").count() >= 0.99 * good.count()
    bad = got.where("quality = 0")
    assert bad.where("not kept").count() >= 0.8 * bad.count()


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "some text", "b"), (3, "word " * 200_000, "c"), (4, " \n", None)]
    rows += [(10 + i, "the plain text of a document that is not bad and has some words in it " * 3 + str(i), "x") for i in range(20)]
    got = q.classify(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert len({(r.score, r.kept) for r in got if r.doc_id in (1, 2, 4)}) == 1
    assert q.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_training_features_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (5 if i % 4 else 5000) + " ".join(f"w{j}" for j in range(i * 20))) for i in range(20)], "doc_id long, _t string")
    every = q._sampled(docs, 100, 1 << 30)
    some = q._sampled(docs, 100, 5000)
    size = lambda rows: sum(len(r["x"]) + len(r["y"]) for r in rows)
    assert len(every) == 20 and size(every) > 5000
    assert 0 < len(some) < 20 and size(some) <= 5000
    assert q._sampled(docs, 100, 0) == []
