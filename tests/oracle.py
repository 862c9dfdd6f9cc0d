"""Order-insensitive comparison of a Spark query with its DuckDB twin."""

import glob
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        c.sql(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    return c


def normal(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> None:
    out = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(out.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(out.fetchall(), out.columns)
