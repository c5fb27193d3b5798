"""Compares a query's rows with those of its oracle SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


def assert_same(got: pd.DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
