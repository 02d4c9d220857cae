"""Holds a query's rows against its SQL, run by DuckDB over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TESTDATA = "/root/testdata"


def plain(x, digits: int):
    if x is None or isinstance(x, (str, bytes, bool)):
        return x
    if isinstance(x, dict):
        return tuple((k, plain(v, digits)) for k, v in sorted(x.items()))
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return tuple(plain(v, digits) for v in x) if not isinstance(x, (int, float)) and hasattr(x, "__iter__") else plain(x.item(), digits)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, digits) + 0.0
    return x


def rows_of(names: list[str], rows, digits: int = 6) -> list[tuple]:
    by = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k], digits) for k in by) for r in rows), key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 4")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """What tells the two results apart; empty if they are equal."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = rows_of(names, found.fetchall())
    if ours == theirs:
        return ""
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{len(ours)} and {len(theirs)} rows {sorted(names)}; only ours: {sorted(a - b)[:3]}; only SQL: {sorted(b - a)[:3]}"
