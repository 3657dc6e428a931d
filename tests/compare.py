"""Compares a query's rows with DuckDB's, in any order, floats to six places."""

import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or (not isinstance(v, dict) and pd.isna(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, np.generic):
        return v.item()
    return v


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


def assert_same(spark, query, sql, sf_dir):
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = db.sql(sql).df()
    got = query(spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
