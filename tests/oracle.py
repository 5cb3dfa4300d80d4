"""Runs a query beside its DuckDB statement and compares rows and values."""

from __future__ import annotations

import datetime
import math

import duckdb

from lodeweave.session import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def kind(x):
    return "none" if x is None else type(x).__name__


def compare(df, con, sql):
    """Difference in words, or None. Column types must agree where values are there."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    left = [tuple(r[n] for n in names) for r in df.collect()]
    order = [rel.columns.index(n) for n in names]
    right = [tuple(r[i] for i in order) for r in rel.fetchall()]
    if not right:
        return "the oracle has no rows"
    for i, name in enumerate(names):
        a, b = {kind(r[i]) for r in left} - {"none"}, {kind(r[i]) for r in right} - {"none"}
        if a and b and a != b:
            return f"{name}: {a} and {b}"
    a, b = (sorted((tuple(map(plain, r)) for r in rows), key=repr) for rows in (left, right))
    if a != b:
        first = next((x for x in zip(a, b) if x[0] != x[1]), (len(a), len(b)))
        return f"{len(a)} and {len(b)} rows; first difference {first}"
    return None
