"""Compares a query with its DuckDB SQL: names, types, and rows in any order."""

import math

import duckdb

from assayer.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v + 0.0:.8g}" if isinstance(v, float) else str(v)


def compare(df, connection, sql):
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    expected = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    order = [names.index(c) for c in df.columns]
    left = sorted(tuple(map(plain, r)) for r in df.collect())
    right = sorted(tuple(plain(r[k]) for k in order) for r in expected)
    assert left == right
