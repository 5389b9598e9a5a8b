"""A query's rows against its SQL in DuckDB, in any order."""

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connected(sf_dir=SMALL):
    found = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = os.path.join(sf_dir, name)
        found.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    return found


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(spark, query, sql, sf_dir=SMALL):
    got = query(spark, sf_dir)
    wanted = connected(sf_dir).sql(sql)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(wanted.columns, wanted.fetchall())
