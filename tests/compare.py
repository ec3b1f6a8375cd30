"""Rows of a query and of its SQL, made comparable."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    con.sql("SET TimeZone = 'UTC'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v + 0.0, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(values):
    return sorted(tuple(map(plain, r)) for r in values)


def same(df, con, sql):
    cols = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    return rows(df.select(*cols).collect()), rows([r[i] for i in at] for r in found.fetchall())
