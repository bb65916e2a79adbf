"""Compares a query's rows with those of its SQL in DuckDB, in any order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _plain(v):
    return repr(float(v)) if isinstance(v, float) else repr(v)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(frame, sql: str, connection) -> str:
    """Empty where both have the same columns and rows."""
    found = connection.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(columns)}"
    ours, theirs = rows_of(frame.columns, frame.collect()), rows_of(columns, found.fetchall())
    return "" if ours == theirs else f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs))[:2]}; only there {list((theirs - ours))[:2]}"
