"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

import math
import os

import duckdb


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(float(v)) else f"{float(v) + 0.0:.5f}"
    return str(v)


def both(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted(([cell(r[n]) for n in names] for r in df.collect()), key=str)
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == names, (sorted(cols), names)
    order = [cols.index(n) for n in names]
    want = sorted(([cell(r[i]) for i in order] for r in res.fetchall()), key=str)
    return got, want
