"""Side by side: a query's rows and those of its SQL."""

import decimal
import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return v if isinstance(v, int) else str(v)


def views(folder=SF):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def same(df, sql, folder=SF):
    columns = sorted(df.columns)
    ours = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    q = views(folder).sql(sql)
    assert columns == sorted(q.columns)
    at = [q.columns.index(c) for c in columns]
    theirs = sorted([tuple(plain(r[i]) for i in at) for r in q.fetchall()], key=repr)
    assert ours == theirs
    return len(ours)
