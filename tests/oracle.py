"""Comparing a query's rows with DuckDB's."""

import datetime
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if not os.path.exists(path):
            continue
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple("" if x is None else "~" + x for x in r)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def same(df, con, sql):
    result = con.execute(sql)
    theirs = rows_of([x[0] for x in result.description], result.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
