"""Compares named queries with their SQL, as the driver does."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def normal(row) -> tuple:
    return tuple(round(v, 4) if isinstance(v, float) and not math.isnan(v) else v for v in row)


def tables(con: duckdb.DuckDBPyConnection, folder: Path = DATA) -> None:
    for p in sorted(folder.glob("*.parquet")):
        con.execute(f"CREATE OR REPLACE VIEW {p.stem} AS SELECT * FROM '{p}'")


def assert_same(df, sql: str, folder: Path = DATA) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    tables(con, folder)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = [normal(r) for r in want.fetchall()]
    got = [normal(r) for r in df.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, got))
