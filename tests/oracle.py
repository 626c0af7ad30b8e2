"""Compares a query with its SQL in DuckDB: same columns, same rows in any order."""

import os

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or (np.isscalar(v) and pd.isna(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in r) for r in frame[cols].itertuples(index=False))


def same(spark, query, sql: str, sf: str = SF) -> int:
    got = query(spark, sf).toPandas()
    con = duckdb.connect()
    for name in os.listdir(sf):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}'")
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
