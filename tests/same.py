"""Comparing a query with its SQL twin in another engine."""

import math
import os

import duckdb


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for f in os.listdir(folder):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return db


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def assert_same(df, db, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted(repr([_plain(v) for v in r]) for r in df.select(*columns).collect())
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert ours == theirs
