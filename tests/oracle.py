"""Rows of a query against those of its SQL in DuckDB."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duckdb_on(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def rows(columns, values):
    order = sorted(columns)
    out = []
    for v in values:
        named = dict(zip(columns, v, strict=True))
        out.append(tuple(round(named[c], 5) + 0.0 if isinstance(named[c], float) else named[c] for c in order))
    return sorted(out, key=repr)


def same(df, con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, found.fetchall())
    assert mine == theirs
