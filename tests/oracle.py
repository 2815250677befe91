"""Rows of a query beside rows of its SQL in DuckDB."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if glob.glob(path + '/*.parquet') else path}'")
    return con


def _cell(x) -> str:
    return "~" if x is None or x != x else f"{float(x):.5f}" if isinstance(x, float) else str(x)


def rows(frame, columns) -> list[tuple]:
    frame = frame[columns].astype(object)
    return sorted(tuple(map(_cell, r)) for r in frame.where(frame.notna(), None).itertuples(index=False))


def assert_same(df, sql: str, sf_dir: str) -> None:
    got, want = df.toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
