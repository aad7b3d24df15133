"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    number = lambda x: x[:-2] if x.endswith(".0") else x
    assert [tuple(map(number, r)) for r in got] == [tuple(map(number, r)) for r in want]
    return len(got)
