"""Runs a query and its SQL on the same tables and compares rows as multisets, by column name."""

import os
from collections import Counter
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else int(x) if isinstance(x, Decimal) and x == int(x) else x


def compare(spark, con, d, name, f, sql):
    df = f(spark, d)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns), (name, cols, df.columns)
    want = Counter(tuple(plain(v) for _, v in sorted(zip(cols, r, strict=True))) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect())
    assert got == want, (name, list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values()), sum(want.values()))
    return sum(got.values())
