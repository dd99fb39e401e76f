"""Runs a query and its SQL over the same tables and compares rows, whatever their order."""

from __future__ import annotations

import os
from pathlib import Path

TABLES = Path(os.environ.get("CORPUSMILL_TABLES", "/root/testdata/sf0.001"))


def connect():
    import duckdb

    con = duckdb.connect()
    for p in sorted(TABLES.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value) -> str:
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 8) + 0.0)
    return str(value)


def compare(spark, con, query, sql: str) -> None:
    df = query(spark, str(TABLES))
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{n}`" for n in names)).collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
