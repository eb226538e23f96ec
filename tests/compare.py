"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows as bags."""

import math
import os
from collections import Counter

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def differences(df, con, sql):
    """(rows only in Spark, rows only in SQL); columns must have the same names."""
    names = sorted(df.columns)
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    one = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    two = Counter(tuple(plain(r[columns.index(n)]) for n in names) for r in cursor.fetchall())
    return one - two, two - one
