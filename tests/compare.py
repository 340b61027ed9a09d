"""Rows of a Spark query and of its SQL, in one form."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT:
        return "null"
    if isinstance(x, str):
        return x
    if hasattr(x, "__len__"):
        return str([plain(v) for v in x])
    try:
        return "null" if x != x else repr(float(x))
    except TypeError:
        return str(x)


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    return sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))
