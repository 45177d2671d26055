"""Runs a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, records, order):
    places = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in places) for r in records)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = connection(sf_dir).execute(sql)
    theirs = [d[0] for d in found.description]
    order = sorted(df.columns)
    assert order == sorted(theirs)
    assert rows_of(df.columns, df.collect(), order) == rows_of(theirs, found.fetchall(), order)
