"""Run a query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.isna(x):
            return ""
        if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
            return f"{float(x):.5g}"
        if isinstance(x, (pd.Timestamp,)) or hasattr(x, "isoformat"):
            return str(x)[:10]
        return str(int(x)) if isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "bi" else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


def differences(spark, run, sql: str, sf_dir: str) -> list:
    a, b = run(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return [("columns", sorted(a.columns), sorted(b.columns))]
    x, y = canonical(a), canonical(b)
    if len(x) != len(y):
        return [("rows", len(x), len(y))]
    return [p for p in zip(x, y) if p[0] != p[1]]
