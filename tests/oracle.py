"""Rows of a query against the rows of its SQL in DuckDB."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


def assert_same(spark, con, sf, query, sql):
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
