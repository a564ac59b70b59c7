"""Compare a Spark result with DuckDB on the same parquet files."""

from __future__ import annotations

import datetime
import math

import duckdb

from strandloom.plans.inputs import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        # One side may have a wider or a decimal type; beyond 2^53 a float would hide differences.
        return float(v) if abs(v) < 1 << 53 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, otherwise a short description."""
    got = df.collect()
    cur = con.execute(sql)
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        return f"{len(a)} rows vs {len(b)}; {list(only_a)[:2]} {list(only_b)[:2]}"[:600]
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]} columns {sorted(names)}"
    return None if len(a) else "both empty"
