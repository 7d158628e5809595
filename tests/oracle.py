"""Compare a query with its SQL on the same tables."""

import os

import duckdb

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MISSING = not os.path.isdir(SF_DIR)


def _told(value):
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


def assert_same(spark, query, sql, sf_dir=SF_DIR):
    """The same columns and the same bag of rows."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_told(r[c]) for c in columns) for r in df.collect())
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        rows = found.fetchall()
    assert sorted(names) == columns
    assert got == sorted(tuple(_told(r[names.index(c)]) for c in columns) for r in rows)
