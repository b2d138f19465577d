"""Compares a query with its SQL in DuckDB over the same tables."""

import glob
import os

import duckdb


def connect(d):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(round(v[i], 6) + 0.0 if isinstance(v[i], float) else v[i] for i in order) for v in values) if values and all(x is not None for v in values for x in v) else sorted((repr(tuple(round(v[i], 6) + 0.0 if isinstance(v[i], float) else v[i] for i in order)) for v in values))


def same(spark, d, con, query, sql):
    df = query(spark, d)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
