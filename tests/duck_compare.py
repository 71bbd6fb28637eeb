"""Runs a query and its SQL over one dataset folder and compares rows without order."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connection(sf_dir: str = SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def compare(spark, name: str, query, sql: str, sf_dir: str = SF) -> None:
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows(got) == rows(want), name
