import hashlib
import random

from quern.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"


def told(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "|", "<", "~", "~0", "~1", "<~1", "\n", "word ", "é", "𝒳", "assistant\n", " "]
    rows = []
    for conv in range(40):
        n = rng.choice([1, 2, 5, 30])
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool\n<|x", "system", None])
            text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 20, 150])))
            rows.append((conv, rng.choice([turn, turn, turn, None, 1]), role, text if rng.random() < 0.9 else None))
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (50, 1, "assistant", "same"), (50, 1, "assistant", "same")]
    rows.append((51, 1, "assistant", "long <| " * 20_000))
    return rows


def test_read_back_equals_the_source(spark):
    rows = rows_of(1)
    for budget, history in ((512, 128), (60, 20), (20, 0)):
        w = c.windows(spark.createDataFrame(rows, SCHEMA), budget, history)
        got = sorted((tuple(r)[:5] for r in c.digest(w).collect()), key=repr)
        assert got == told(rows)


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"text number {i} of many") for i in range(1, 60)]
    got = sorted(c.windows(spark.createDataFrame(rows, SCHEMA), 60, 20).collect(), key=lambda r: r.window)
    assert [r.window for r in got] == list(range(len(got))) and len(got) > 5
    seen = []
    for r in got:
        parts = r.formatted.split(c.START)[1:]
        assert parts[0].startswith("system\nbe kind")
        assert r.repeated == 0 if r.window == 0 else r.repeated >= 1
        assert r.tokens == sum(len(p.replace(c.END, "").split()[1:]) + 3 for p in parts) <= 60
        spans = [r.formatted[a:b] for a, b in r.loss]
        assert all(s.startswith("text number") for s in spans)
        seen += spans
    assert seen == [t for _, _, role, t in rows if role == "assistant"]
    assert any(r.repeated > 1 for r in got)


def test_no_window_exceeds_the_budget_unless_one_turn_does(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(120):
        sizes = [rng.choice([0, 5, 60, 200, 380, 480, 493, 600]) for _ in range(rng.randrange(1, 25))]
        rows += [(conv, i, "system" if i == 0 and conv % 4 else rng.choice(["user", "assistant"]), "w " * n, n + 7) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, SCHEMA + ", counted int")
    for tokens, more in ((None, 0), ("counted", 7)):
        w = c.windows(df, tokens=tokens).collect()
        turns = {}
        for conv, _, role, text, _ in rows:
            turns.setdefault(conv, []).append((role, len(text.split()) + c.MARKS + more))
        for r in w:
            parts = r.formatted.split(c.START)[1:]
            assert r.tokens == sum(p.count("w ") + c.MARKS + more for p in parts)
            assert r.tokens <= c.BUDGET or len(parts) == 1
            role, n = turns[r.conv_id][0]
            if r.window and role == "system" and n <= (c.BUDGET - c.HISTORY) // 2:
                own = r.tokens - sum(p.count("w ") + c.MARKS + more for p in parts[: r.repeated])
                assert parts[0].startswith("system") == (n + own <= c.BUDGET)
        assert any(r.repeated > 1 for r in w)
        got = sorted((tuple(r)[:5] for r in c.digest(spark.createDataFrame(w)).collect()), key=repr)
        assert got == told([r[:4] for r in rows])


def test_turns_are_listed_once(spark):
    rows = rows_of(2)
    w = c.windows(spark.createDataFrame(rows, SCHEMA), 60, 20)
    got = sorted((r.conv_id, r.role, r.text) for r in c.turns(w).collect() if r.conv_id is not None)
    assert got == sorted((a, r or "", t or "") for a, _, r, t in rows if a is not None)


def test_empty_table_and_other_columns(spark):
    assert c.digest(c.windows(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, 0, "user", "hi", "x", 5), (1, 1, "assistant", "yo", "y", 6)]
    got = c.digest(c.windows(spark.createDataFrame(rows, SCHEMA + ", formatted string, _i int"))).collect()
    assert [tuple(g)[:5] for g in got] == told([r[:4] for r in rows])
