"""Comparison of a query with its SQL on the smallest tables."""

import math
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def sql_rows(sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{name}')")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
