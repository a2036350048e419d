"""A query's rows against its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(df, sql, c):
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    found = c.sql(sql)
    assert sorted(found.columns) == sorted(cols)
    order = sorted(cols)
    ours = sorted(tuple(_plain(r[cols.index(k)]) for k in order) for r in rows)
    theirs = sorted(tuple(_plain(r[found.columns.index(k)]) for k in order) for r in found.fetchall())
    assert ours == theirs
