"""Plain Python answers for small inputs."""

from __future__ import annotations

import re


def jaccard_components(docs: list[tuple], k: int = 4, percent: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id) for (doc_id, text), by comparing all pairs."""
    sets = []
    for _, text in docs:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is None or docs[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            near = both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if near or (docs[i][0] == docs[j][0] and sets[i] and sets[j]):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(docs)]


def quality(text: str | None) -> dict:
    """The counts and verdict of the quality rules."""
    from quern.llm.quality_rules import RULES, STOP_WORDS

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, stops = len(w), set(STOP_WORDS)
    got = {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
    got["base_failed"] = n < 50 or 100 * len(covered) > 50 * n
    over = lambda x, y: x / y if y else 0.0
    measured = {
        "mean_word_chars": over(got["word_chars"], n),
        "symbol_ratio": over(got["n_symbols"], n),
        "mark_ratio": over(text.count("!"), n),
        "stop_ratio": over(sum(x.lower() in stops for x in w), n),
        "dup_line_ratio": over(got["n_dup_lines"], len(lines)),
    }
    fits = all((r.low is None or measured[r.measure] >= r.low) and (r.high is None or measured[r.measure] <= r.high) for r in RULES)
    got["kept"] = not got["base_failed"] and fits
    return got
