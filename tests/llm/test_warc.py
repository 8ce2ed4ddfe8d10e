import hashlib
from pathlib import Path

import pytest

from quern.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows():
    long_ = "<p>" + "é" * 90 + "</p>"
    out = [(i, f"http://a/{i}", f"<html>page {i} " + "x" * 200 * i + "</html>") for i in range(40)]
    out += [(100 + i, "http://same", long_) for i in range(30)]
    out += [(100, "http://same", long_), (100, None, long_), (None, "http://none", long_), (None, None, None), (200, "a\r\nb: c", ""), (201, "", None)]
    out += [(300, "u", "short"), (301, "u", "short"), (302, "u", "x" * 99), (303, "u", "x" * 99), (304, "u", "y" * 100), (305, "u", "y" * 100)]
    out += [(400, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (401, "u", "\x00\x01" * 80), (402, "big", "long " * 300_000)]
    return out


def expected(pages):
    least, seen, out = {}, set(), []
    for p, _, html in pages:
        least.setdefault(html or "", []).append(p)
    for p, _, html in pages:
        data = (html or "").encode()
        lo = min((x for x in least[html or ""] if x is not None), default=None)
        first = len(data) < 100 or (p == lo and (html, lo) not in seen)
        if p == lo:
            seen.add((html, lo))
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if first else "revisit", None if first else lo))
    return sorted(out, key=repr)


def files(folder: Path):
    return {p.name: p.read_bytes() for p in folder.glob("*.warc.gz")}


def test_round_trip(spark):
    pages = rows()
    got = warc.round_trip(spark.createDataFrame(pages, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(pages)


def test_files_depend_on_the_table_alone(spark, tmp_path):
    pages = rows()
    for k, n in enumerate((1, 7)):
        df = spark.createDataFrame(pages[::-1] if k else pages, SCHEMA).repartition(n)
        manifest = warc.write(df, f"file://{tmp_path}/{k}", shard=4000, roll=1500)
        assert manifest.count() > 5
    a, b = files(tmp_path / "0"), files(tmp_path / "1")
    assert a == b and len(a) > 5
    assert not (tmp_path / "0" / "_temporary" / "x").exists()
    listed = {r["file"]: (r["bytes"], r["sha256"]) for r in manifest.collect()}
    assert listed == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in b.items()}
    html = {(r.page_id, r.html) for r in warc.read(spark, f"file://{tmp_path}/0").collect() if r.record_type == "response"}
    assert {h for _, h in html} == {h or "" for _, _, h in pages}


def test_damage_is_found(spark, tmp_path):
    warc.write(spark.createDataFrame(rows()[:5], SCHEMA), f"file://{tmp_path}/x")
    (name,) = files(tmp_path / "x")
    p = tmp_path / "x" / name
    p.write_bytes(p.read_bytes()[:-5])
    with pytest.raises(Exception, match="archive ends"):
        warc.read(spark, f"file://{tmp_path}/x").collect()


def test_empty_table_and_other_columns(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "u", "a" * 200, "s", 3), (2, "u", "a" * 200, "t", 4)], SCHEMA + ", digest string, shard int")
    assert [r.record_type for r in warc.round_trip(df).orderBy("page_id").collect()] == ["response", "revisit"]
