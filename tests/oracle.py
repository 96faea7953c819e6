"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x if x is None or isinstance(x, (int, str, bool)) else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(con, df, sql: str) -> str:
    """Empty if both sides agree, else what differs."""
    names, ours = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs_names, theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != theirs_names:
        return f"columns {names} and {theirs_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; {[x for x in ours if x not in theirs][:3]} / {[x for x in theirs if x not in ours][:3]}"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else ""
