import random

from quern.operators import reversi

WAYS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def played(board, i, j, p):
    o = "O" if p == "X" else "X"
    out = set()
    for a, b in WAYS:
        run, x, y = [], i + a, j + b
        while 0 <= x < 8 and 0 <= y < 8 and board[x * 8 + y] == o:
            run.append(x * 8 + y)
            x, y = x + a, y + b
        if run and 0 <= x < 8 and 0 <= y < 8 and board[x * 8 + y] == p:
            out.update(run)
    return out


def best(board, p):
    o = "O" if p == "X" else "X"
    flat = [w for r in reversi.WEIGHTS for w in r]
    found = None
    for k in range(64):
        if board[k] == "*" and (turned := played(board, k // 8, k % 8, p)):
            after = "".join(p if c == k or c in turned else board[c] for c in range(64))
            score = sum(w for w, c in zip(flat, board, strict=True) if c == p) - sum(w for w, c in zip(flat, after, strict=True) if c == o)
            if score > reversi.LEAST and (found is None or score > found[1]):
                found = (k // 8 * 10 + k % 8, score, after)
    return found


def test_same_as_plain_play(spark):
    rng = random.Random(6)
    boards = [("*" * 27 + "OX" + "*" * 6 + "XO" + "*" * 27, "X"), ("*" * 64, "X"), ("X" * 63 + "*", "X"), ("X" * 64, "O")]
    boards += [("".join(rng.choice("**XO") for _ in range(64)), rng.choice("XO")) for _ in range(25)]
    cells = [(n, p, k // 8, k % 8, b[k]) for n, (b, p) in enumerate(boards) for k in range(64)]
    got = reversi.greedy(spark.createDataFrame(cells, "board_id int, player string, i int, j int, cell string")).collect()
    want = {n: m for n, (b, p) in enumerate(boards) if (m := best(b, p))}
    assert {r.board_id: (r.cell, r.score, r.after) for r in got} == want and 0 in want
