"""Rows of a registered query beside the rows of its DuckDB SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES.split():
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
