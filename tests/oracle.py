"""Compares a query with its SQL: the same columns, and the same rows as a multiset."""

import glob
import os

import duckdb


def text(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def duck(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(text(r[c]) for c in cols) for r in df.collect())


def sql_rows(connection, sql):
    r = connection.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(text(row[i]) for i in order) for row in r.fetchall())
