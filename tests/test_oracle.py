"""Registered queries against their SQL in DuckDB."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

from chunkflow.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, dict)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_pack_books_lists_no_books(spark):
    got = QUERIES["pack_books"](spark, "/root/testdata/sf0.001")
    assert got.count() == 200 * 8 and not [f for f in got.inputFiles() if f.endswith(".epub")]
