"""Compares a query with its SQL over the same Parquet tables."""

import decimal
import os

import duckdb

DATA = os.environ.get("DOCJOBS_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows_of(table, names):
    return sorted(tuple(map(plain, r)) for r in zip(*(table.column(c).to_pylist() for c in names)))


def same(df, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    mine, theirs = df.toArrow(), con.sql(sql).to_arrow_table()
    names = sorted(mine.column_names)
    assert names == sorted(theirs.column_names)
    assert rows_of(mine, names) == rows_of(theirs, names)
