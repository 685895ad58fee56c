"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({files})")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> tuple[list[str], list[str], list[tuple], list[tuple]]:
    """Column names and sorted rows of both sides."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = connect(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    return sorted(df.columns), sorted(names), mine, rows_of(names, got.fetchall())
