"""Compares a query with its SQL, as rows."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def _plain(x):
    return round(x, 9) if isinstance(x, float) else x


def assert_same(df, con, sql):
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    kinds = dict(df.dtypes)
    assert [TYPES[kinds[c]] for c in cols] == [str(rel.types[i]) for i in at]
    mine = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return len(mine)
