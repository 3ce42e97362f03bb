"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tables(folder: str = DATA):
    c = duckdb.connect()
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(tuple, clean.itertuples(index=False)), key=repr)


def same(df, sql: str, folder: str = DATA) -> None:
    mine, theirs = df.toPandas(), tables(folder).sql(sql).df()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    assert rows(mine, columns) == rows(theirs, columns)
