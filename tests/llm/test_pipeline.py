"""Each stage against a brute-force version, on what the stage before kept."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import jaccard_components, quality
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quern.llm import mixing, packing, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def kept(spark):
    from quern.llm.shared import stage

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        out.append((docs, docs := stage(f(spark, docs, SF), "test")))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == out[0][0].columns
    return out


def test_quality(kept):
    before, after = kept[0]
    assert sorted(rows(after)) == sorted((d, t) for d, t in rows(before) if quality(t)["kept"])


def test_exact(kept):
    before, after = kept[1]
    best = {}
    for d, t in rows(before):
        best[t] = max(best.get(t, d), d)
    assert sorted(rows(after)) == sorted((d, t) for t, d in best.items())


def test_near(kept):
    before, after = kept[2]
    groups = jaccard_components(rows(before))
    assert sorted(d for d, _ in rows(after)) == sorted(d for d, _, c in groups if c == d)
    assert len(rows(after)) < len(groups)


def test_near_takes_five_words_and_eighty_hundredths(spark):
    base = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(base))]
    # Two words apart: 86 of 106 shingles of five words are shared, but 89 of 105 of four.
    docs += [(2, " ".join("x" if i in (30, 60) else w for i, w in enumerate(base)))]
    docs += [(3, " ".join("y" if i in (20, 45, 70) else w for i, w in enumerate(base))), (4, "another text of its own")]
    got = corpus_pipeline.near(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF)
    want = sorted(d for d, _, c in jaccard_components(docs, 5, 80) if c == d)
    assert sorted(d for d, _ in rows(got)) == want == [1, 3, 4]


def test_mixed(spark, kept):
    before, after = kept[3]
    copies = {r.doc_id: r.copies for r in mixing.mix(before, queries.labelled(spark, SF), corpus_pipeline.TARGETS).collect()}
    assert Counter(d for d, _ in rows(after)) == +Counter(copies)


def test_packed(kept):
    before, after = kept[4]
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(queries.vocabulary())
    want = Counter()
    for d, text in rows(before):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        for s in range(0, len(ids), packing.SIZE):
            piece = ids[s : s + packing.SIZE]
            want[(d, s, len(piece), packing.zlib.crc32(piece.tobytes()), len(ids))] += 1
    got = after.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= packing.SIZE
    # Long rests leave windows that nothing fits; no fewer windows hold the pieces in order of length.
    assert len(filled) == packing.best_fit_decreasing(Counter(r.length for r in got))[1]


def test_run_gives_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, SF).groupBy().agg(F.count("*"), F.sum("ids_crc32")).first()
    assert got == kept[-1][1].groupBy().agg(F.count("*"), F.sum("ids_crc32")).first()
