"""Spark result against DuckDB result, without regard to order."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pandas as pd


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float | np.floating) and np.isnan(x)):
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, int | np.integer):
        return int(x)
    if isinstance(x, float | np.floating):
        return float(f"{x:.9g}")
    if isinstance(x, np.ndarray):
        return tuple(map(plain, x))
    return str(x)


def rows(frame) -> Counter:
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


def views(folder: str):
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        con.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    return con


def check(spark, folder: str, query, sql: str) -> None:
    got = query(spark, folder).toPandas()
    want = views(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
