import random

from brute import quality

from quern.llm import quality_rules as q

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def texts():
    rng = random.Random(9)
    pool = ["the", "of", "und", "word", "é", "x#", "a|b", "$$$", "no!", "UPPER", "İ", "ς", " ", " x"]
    out = [None, "", " ", "\n\n", "one", "a b c a b c", "same line\nsame line\n same line\n\n", "\x0b\x0c\r\t", "a\x0bb\x0cc", "x " * 30_000, "\x1ca\x1fb"]
    for n in (3, 20, 60, 60, 60, 200, 200, 1000):
        out += ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(n)) for _ in range(6)]
    out += [" ".join(f"w{rng.randrange(k)} the" for _ in range(80)) for k in (2, 5, 30, 1000)]
    return out


def test_same_as_plain_python(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "the of " * 40, "x"), (0, None, "x")]
    got = q.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    want = [(d, *(quality(t)[c] for c in COUNTS)) for d, t, _ in rows]
    assert sorted(map(repr, ((r.doc_id, *(r[c] for c in COUNTS)) for r in got))) == sorted(map(repr, want))


def test_keep_has_all_columns_and_rules_are_compiled(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = q.keep(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, t, _ in rows if quality(t)["kept"]]
    none = q.judge(df, []).where("not kept and not base_failed")
    assert none.count() == 0
    strict = q.judge(df, [q.Rule("symbol_ratio", None, 0.0)]).where("kept").collect()
    assert all(r.n_symbols == 0 for r in strict)


def test_empty_table(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
