import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quern.llm import packing as p
from quern.llm import queries

VOCABULARY = queries.vocabulary()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abAB'st.,;́éßµªΣ1½\x01<|> \t\n  İ", max_size=60)), max_size=4))
@example(["İ.", "aİ,", "e\u0301.", "\u0301."])
def test_chunks_give_the_ids_of_the_whole(plain, texts):
    got = p.encoder(VOCABULARY)(texts)
    for data, t in zip(got, texts, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "<|StartOfText|>"]), st.text(alphabet="abAB.,<|> \né", max_size=8)), max_size=6))
@example(["a <|ENDOFTEXT|> b"])
@example(["A<|ENDOFTEXT|>B."])
def test_added_tokens_in_other_case(plain, parts):
    texts = [" ".join(parts), "".join(parts)]
    for data, t in zip(p.encoder(VOCABULARY)(texts), texts, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def one_by_one(lengths, size):
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = min((c, i) for i, c in enumerate([*free, size]) if c >= n)[1]
        if k == len(free):
            free.append(size)
        free[k] -= n
    return Counter(free)


def test_bulk_packing_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([16, 50, 2048])
        lengths = [rng.randint(1, rng.choice([size, max(1, size // 5)])) for _ in range(rng.randint(0, 200))]
        plan, used = p.best_fit_decreasing(Counter(lengths), size)
        windows = defaultdict(list)
        for n, lo, hi, first, each, offset in plan:
            for r in range(lo, hi + 1):
                windows[first + (r - lo) // each].append((offset + (r - lo) % each * n, n))
        for v in windows.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
        assert len(windows) == used
        assert Counter(size - sum(n for _, n in v) for v in windows.values()) == one_by_one(lengths, size)


def test_pieces_and_sequences(spark, plain):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "Blue,", "x1", "é."]) for _ in range(rng.choice([0, 5, 40, 300]))), 7) for i in range(80)]
    rows += [(90, None, 1), (91, "", 1), (91, "", 1), (None, "no id", 1), (92, "long text " * 3000, 1), (93, "word" * 5000, 1)] + [(100 + i, "same words", 1) for i in range(60)]
    packed = p.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), VOCABULARY, size=64, keep_ids=True)
    want = Counter()
    for d, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, p.END], "<u4")
        for s in range(0, len(ids), 64):
            want[(d, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids))] += 1
    got = packed.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    placed = defaultdict(dict)
    for r in got:
        placed[r.sequence_id][r.offset] = r
    for s in p.sequences(packed, 64).collect():
        pieces = placed.pop(s.sequence_id)
        ids = b"".join(bytes(pieces[o].ids) for o in sorted(pieces))
        assert s.tokens[: s.filled] == np.frombuffer(ids, "<u4").tolist() and s.filled == len(ids) // 4
        assert len(s.tokens) == (s.filled if s.filled & (s.filled - 1) == 0 else 64) and not any(s.tokens[s.filled :])
    assert not placed


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_vocabulary_gives_the_ids_of_whole_texts(name):
    import numpy as np
    from tokenizers import Tokenizer

    vocabulary = queries.vocabulary(name)
    whole, encode = Tokenizer.from_str(vocabulary), p.ChunkEncoder(vocabulary)
    assert encode.by_chunks == (name == "word_bpe_49k.json")
    texts = ["Don't  stop, the QUICK\n\nfox; élan 你好 x.y 12,5.", "", "a <|ENDOFTEXT|> b", *p.ChunkEncoder.PROBES]
    for t, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_repeated_rows_are_packed_once_each(spark):
    rows = [(1, "the same text")] * 500 + [(None, None)] * 30
    got = p.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.vocabulary()).collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(got) == len(places) == 530
