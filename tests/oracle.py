"""Runs a query and its SQL side by side."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    con = duck(sf)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols, (sorted(names), cols)
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    assert not diff, diff[:3]
    return len(got)
