"""Every registered query of the library against its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from siltstone.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())


#: The small tables have no page with images.
EMPTY = {"page_images"}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_queries_without_sql_have_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).isEmpty() == (name in EMPTY)
