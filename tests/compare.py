"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def oracle(folder: str | Path, sql: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{where}'")
    return con.sql(sql)


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, canon(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(canon(r[i]) for i in order)) for r in data))


def assert_same(df, folder, sql):
    want = oracle(folder, sql)
    assert sorted(df.columns) == sorted(want.columns), (df.columns, want.columns)
    a, b = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    assert a == b, f"{len(a)} rows, want {len(b)}; extra {extra}; missing {missing}"
    return len(a)
