"""A query's rows and DuckDB's, for comparison."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat(" ") if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, db, query, sql, sf):
    df = query(spark, sf)
    rel = db.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
    return len(ours)
