"""Rows of a query against rows of its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("FRAMELAKE_TEST_DATA", "/root/testdata/sf0.001")


def connect(sf_dir=DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows])


def same(df, sql, sf_dir=DATA):
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = connect(sf_dir).execute(sql)
    want = normal(cur.fetchall(), [d[0] for d in cur.description])
    assert got == want
