"""A query's rows against those of its SQL twin in DuckDB."""

import math
import os
from decimal import Decimal

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    c.sql("SET max_temp_directory_size = '4GB'")
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return c


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool) or not isinstance(x, (int, float, Decimal)):
        return str(x)
    return f"{float(x) + 0.0:.6g}"


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(_cell(x) for x in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))


def assert_same(spark, folder, query, sql):
    ours = rows_of(query(spark, folder).toPandas())
    theirs = rows_of(connection(folder).sql(sql).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
