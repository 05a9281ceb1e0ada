"""Runs a query's SQL in DuckDB over the same tables and compares values, whatever their order."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(([plain(x) for x in r] for r in df.itertuples(index=False)), key=str)
