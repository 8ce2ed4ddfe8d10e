import random
import re

from quern.llm import license_scan as s

SCHEMA = "doc_id long, text string, label string"


def base(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at, labels = [], set()
    for phrase, label in s.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


MIT = next(t for n, t in s.TEMPLATES if n == "mit")
TEXTS = [
    None, "", "   ", "MIT", "mit license", "The MIT-License, mit\nLICENSE. mit licenses", "General Public License general public LICENSE",
    "general public licence license", "MİT license MIK license", "mité license émit license", "apache license mit license apache license",
    "mit license " * 20_000, "license mit", "general general public public license license", "ｍit license", "mit\x00license \x7fmit\x7flicense",
    "GNU General Public\n\tLicense", "x " * 500 + MIT.upper() + " y" * 500, MIT.replace("charge", "charge and without cost"), MIT + " " + MIT, MIT[: len(MIT) // 4],
]


def test_base_columns_match_plain_python(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "mit license", "x"), (4, "mit license", "x"), (4, "mit license", "x")]
    got = s.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(repr((d, *base(t))) for d, t, _ in rows)
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_edited_templates_are_found_and_fragments_are_not(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS[-4:])]
    got = {r.doc_id: r for r in s.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].labels == "mit" and got[0].score == 1 and got[0].spans[0].first_word == 500
    assert got[1].labels == "mit" and s.LEAST < got[1].score < 1
    assert len(got[2].spans) == 2 and got[3].labels == ""


NOTICES = {
    "Licensed under CC BY 4.0": "cc",
    "licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa",
    "Respect all rights of others": "",
    "the rights reserved for the seats": "",
    "All Rights Reserved.": "reserved",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd",
    "work is licensed under the terms of the GNU General Public License, version 3": "gpl",
    "in compliance with the law you may obtain a copy": "",
    "free of charge to any person": "",
    "subject to the terms of the agreement": "",
    "licensed under licensed under licensed under licensed under cc by 4 by 4 by 4": "",
}


def aligned(text):
    """Labels by aligning every template at every place, by plain loops over words."""
    w = re.findall("[a-z0-9]+", text.lower())
    spans = []
    for number, (label, template) in enumerate(s.TEMPLATES):
        t = template.split()
        telling = [j for j in range(len(t) - 1) if not {t[j], t[j + 1]} <= s.COMMON]
        hits = sorted((i - j, i, j) for j in telling for i in range(len(w) - 1) if w[i : i + 2] == t[j : j + 2])
        groups = []
        for d, i, j in hits:
            if groups and d - groups[-1][-1][0] <= s.GAP:
                groups[-1].append((d, i, j))
            else:
                groups.append([(d, i, j)])
        for g in groups:
            places = {j for _, _, j in g}
            if len(places) >= (len(telling) if len(telling) < s.SHORT else s.LEAST * len(telling)):
                spans.append((min(i for _, i, _ in g), max(i for _, i, _ in g) + 1, len(places) / len(telling), label, number))
    out = set()
    for family in {x[3].split("-")[0] for x in spans}:
        own, end, chain = sorted(x for x in spans if x[3].split("-")[0] == family), -1, []
        for x in [*own, (10**9, 0, 0, "", 0)]:
            if x[0] > end and chain:
                out |= {y[3] for y in chain if y[2] == max(z[2] for z in chain)}
                chain = []
            chain.append(x)
            end = max(end, x[1])
    return ",".join(sorted(out))


def test_labels_of_notices_and_near_misses(spark):
    texts = list(NOTICES)
    rng = random.Random(4)
    for _ in range(150):
        w = rng.choice([x for _, x in s.TEMPLATES] + texts).split()
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(3)] = rng.choice([[], ["word"], ["the", "license"], ["nc"], w[:5]])
            w = w or ["x"]
        texts.append(" ".join(w))
    texts += [" . ".join(rng.sample(texts, 3)) for _ in range(60)]
    got = {r.doc_id: r for r in s.scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        own = set(filter(None, got[i].labels.split(","))) - {x.label for x in got[i].spans if x.template <= len(s.PHRASES)}
        assert own <= set(filter(None, aligned(t).split(","))), t
        assert set(filter(None, aligned(t).split(","))) <= set(got[i].labels.split(",")), t
        if t in NOTICES:
            assert set(filter(None, got[i].labels.split(","))) == set(filter(None, NOTICES[t].split(","))), t


def test_empty_table(spark):
    assert s.scan(spark.createDataFrame([], SCHEMA)).count() == 0
