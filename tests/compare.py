"""Compares registered queries with their SQL on DuckDB."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def value(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int32", "int64", "float64"):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(value(r[i]) for i in order) for r in data], key=str)


def difference(spark, con, query, sql, sf_dir):
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return None
    a, b = set(got[1]), set(want[1])
    return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b, key=str)[:2]}, only in SQL {sorted(b - a, key=str)[:2]}"
