"""Compare a query with its SQL as the driver does: columns by name, rows in any order."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def same(df, con, sql):
    rows, cols = df.collect(), df.columns
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(names)
    order = sorted(cols)
    got = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert len(got) == len(want)
    assert got == want
    return len(got)
