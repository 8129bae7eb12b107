"""Runs a registered query and its SQL statement on the same tables and compares the results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return (0, "nan")
        return (2, repr(value + 0.0))
    return (3, str(value))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    theirs = [dict(zip(names, r)) for r in expected.fetchall()]
    ours = [r.asDict() for r in df.collect()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    left = sorted(tuple(_cell(r[c]) for c in order) for r in ours)
    right = sorted(tuple(_cell(r[c]) for c in order) for r in theirs)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        a, b = wrong[0]
        return f"{len(wrong)} of {len(left)} rows differ in {order}: {[x[1] for x in a]} against {[x[1] for x in b]}"
    return None
