"""Compares a query with its SQL in DuckDB on one data directory."""

from __future__ import annotations

import math
import os

import duckdb

TESTDATA = "/root/testdata"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def connect(d: str):
    c = duckdb.connect()
    for f in sorted(os.listdir(d)):
        p = f"{d}/{f}" + ("/*.parquet" if os.path.isdir(f"{d}/{f}") else "")
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return c


def compare(spark, query, sql: str, d: str) -> tuple[int, int, list, list]:
    """Rows of both, and the rows that only one has."""
    from collections import Counter

    df = query(spark, d)
    cols = sorted(df.columns)
    a = Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    r = connect(d).execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols, (names, cols)
    at = [names.index(x) for x in cols]
    b = Counter(tuple(norm(row[i]) for i in at) for row in r.fetchall())
    return sum(a.values()), sum(b.values()), list((a - b).items())[:5], list((b - a).items())[:5]
