"""Compares a query with its SQL over the same tables, as the driver does: columns by name, rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    wanted = rows_of(got.columns, got.fetchall())
    assert len(found) == len(wanted)
    different = [(a, b) for a, b in zip(found, wanted, strict=True) if a != b]
    assert not different, different[:3]
