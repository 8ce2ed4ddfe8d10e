import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import substring_dedup as s

SCHEMA = "doc_id long, text string"
DATA = "/root/testdata/sf0.01"


def pieces(text, unit):
    """(text, start, key) of each unit."""
    cut = {"clause": r"(?<=[.!?,;:])[ \t-\r]|\n", "line": "\n", "paragraph": "\n\n"}[unit]
    out, at, held = [], 0, ""
    if not (text or "").encode().split():
        return out
    for m in [*re.finditer(cut, text), None]:
        p = text[at + len(held) : m.end() if m else None]
        held += p
        enough = unit != "clause" or p.endswith("\n") or len(p.encode().split()) >= s.SHORT
        if m is None and not held.encode().split():
            u, a, key = out.pop()
            out.append((u + held, a, key))
        elif held.encode().split() and (enough or m is None):
            out.append((held, at, b" ".join(held.encode().lower().split())))
            at, held = at + len(held), ""
    return out


def brute(rows, unit, passage):
    """The rows of removed() and, by place in rows, the texts that are left. Ties fall to the earlier row."""
    every = {i: pieces(t, unit) for i, (_, t) in enumerate(rows)}
    order = sorted((d is None, d or 0, a, i, k) for i, (d, _) in enumerate(rows) for _, a, k in every[i])
    first = {}
    for _, _, a, i, k in order:
        first.setdefault(k, (i, a))
    cut, left = [], {}
    for i, (d, text) in enumerate(rows):
        run, gone = [], []
        for u, a, k in [*every[i], ("", -1, None)]:
            if k is not None and first[k] != (i, a):
                run.append((u, a, k))
            else:
                gone += run if sum(len(k.split()) for _, _, k in run) >= passage else []
                run = []
        cut += [(d, a, len(u), rows[first[k][0]][0], first[k][1]) for u, a, k in gone]
        left[i] = text or ""
        for u, a, _ in reversed(gone):
            left[i] = left[i][:a] + left[i][a + len(u) :]
    return sorted(cut, key=repr), left


def rows_of(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["á", "b.", "C", "dd,"]) for _ in range(rng.choice([2, 5, 9, 40]))) for _ in range(30)]
    pool += ["", " ", "x " * 9, "X  x\tx x x x x x X", "É É É É É É", "é é é é é é", "\u2003a\u2003 b c d e f", "a b c d e f", "..\t?! a;\r:\x0b"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100 + i, pool[3] + " and more of it to be long\nown line of document " + str(i)) for i in range(90)]
    rows += [(300, None), (301, ""), (None, pool[5] + "\n" + pool[6]), (302, "long line " * 20_000 + "\nend"), (303, "a b c d e f g h i j\n\na b c d e f g h i j")]
    return rows


@pytest.mark.parametrize("unit", ["clause", "line", "paragraph"])
def test_same_as_brute_force(spark, unit):
    rows = rows_of(4)
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, _ = brute(rows, unit, 5)
    assert sorted(map(tuple, s.removed(df, unit, 5).collect()), key=repr) == want


def test_cleaned_texts_and_repeated_rows(spark):
    rows = rows_of(5)
    rows += [rows[70], rows[3], (None, None)]
    df = spark.createDataFrame([(d, t, i, "r") for i, (d, t) in enumerate(rows)], SCHEMA + ", n int, removed string").coalesce(1)
    out = s.clean(df, "clause", 5).collect()
    _, want = brute([(i, t) for i, (_, t) in enumerate(rows)], "clause", 5)
    for r in out:
        assert (r.text or "") == want[r.n]
        if not r.removed:
            assert r.text == rows[r.n][1]


def test_one_of_repeated_rows_keeps_its_units(spark):
    text = "a passage of many words, " * 6
    rows = [(7, text), (7, text), (None, text), (None, text)]
    got = [tuple(r) for r in s.removed(spark.createDataFrame(rows, SCHEMA)).collect()]
    # Within a row the first unit is earliest; of the two rows 7 one has it, and loses the other five.
    at = [25 * n for n in range(6)]
    assert sorted(a for d, a, *_ in got if d == 7) == sorted(at + at[1:])
    assert sum(d is None for d, *_ in got) == 12 and {r[3:] for r in got} == {(7, 0)}


def test_a_passage_in_short_lines_goes_and_stock_phrases_stay(spark):
    verse = "\n".join(f"{w} line {i} of\n\na\npassage" for i, w in enumerate("one two three four five six seven".split()))
    rows = [(1, "first\n" + verse), (2, verse + "\nsecond"), (3, "third, of the kind. One line 0 of\nsecond")]
    got = sorted(map(tuple, s.removed(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == brute(rows, "clause", s.PASSAGE)[0]
    assert {d for d, *_ in got} == {2}  # "a" and "passage" repeat inside document 1, too, but not as a run
    left = {r.doc_id: r.text for r in s.clean(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert left[2].strip().split("\n")[-1] == "second" and len(left[2]) < len(verse) / 2 and left[3] == rows[2][1]


def test_a_passage_inside_lines_goes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", "", ",", ".", ".\n"]) for _ in range(n))
    passages = [text(rng.randrange(60, 120)) for _ in range(20)]
    rows, held = [], {}
    for i in range(300):
        own = text(rng.randrange(80, 300)).split(" ")
        if i % 3 == 0:
            k, at = rng.randrange(20), rng.randrange(len(own))
            held.setdefault(k, []).append((i, len(passages[k])))
            own[at:at] = passages[k].split(" ")
        rows.append((i, " ".join(own)))
    got = s.removed(spark.createDataFrame(rows, SCHEMA)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    cut = {r.doc_id: r.n for r in got}
    later = [x for v in held.values() for x in v[1:]]
    # Only the clauses at the passage's two ends are not its own.
    assert sum(cut.get(i, 0) >= n / 2 for i, n in later) >= 0.95 * len(later)
    assert not [i for i in cut if i % 3]


def test_recall_on_real_tables(spark):
    """Of documents that hold 50 words of an earlier one, and not mostly such, nearly all lose half of them or more; clean ones are left alone."""
    docs = sorted(map(tuple, spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    at = {d: [m.span() for m in word.finditer(t)] for d, t in docs}
    words = {d: [t[a:b].lower() for a, b in at[d]] for d, t in docs}

    def repeated(k):
        seen, out = {}, {}
        for d, _ in docs:
            w = words[d]
            for j in range(len(w) - k + 1):
                if seen.setdefault(tuple(w[j : j + k]), d) != d:
                    out.setdefault(d, set()).update(range(j, j + k))
        return out

    cut = {}
    for r in s.removed(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        cut.setdefault(r.doc_id, set()).update(j for j, (a, b) in enumerate(at[r.doc_id]) if r.start <= a and b <= r.start + r.length)
    # Junk that says one word again and again has no passages.
    held = {d: x for d, x in repeated(50).items() if 2 * len(x) < len(words[d]) and len({words[d][j] for j in x}) >= 25}
    caught = [len(cut.get(d, set()) & x) >= len(x) / 2 for d, x in held.items()]
    assert len(caught) >= 20 and sum(caught) >= 0.9 * len(caught)
    # Clean: labelled good, and nothing of 13 words in common with an earlier document.
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 and toxic = 0").collect()} - set(repeated(13))
    assert len(good) > 100 and sum(d in cut for d in good) <= 0.01 * len(good)


def test_empty_table(spark):
    assert s.removed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert s.clean(spark.createDataFrame([], SCHEMA)).count() == 0
