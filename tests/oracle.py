"""Holds a Spark result against DuckDB's over the same Parquet tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return [_plain(y) for y in x]
    if isinstance(x, float):
        return int(x) if x.is_integer() and abs(x) < 2**53 else round(x, 9)  # pandas makes doubles of whole numbers with nulls
    return x


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([_plain(x) for x in r]) for r in df.itertuples(index=False))


def assert_same(got: DataFrame, sql: str, sf_dir: str) -> None:
    want = connection(sf_dir).execute(sql).df()
    mine = got.toPandas()
    assert sorted(mine.columns) == sorted(want.columns)
    a, b = rows(mine), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3]
