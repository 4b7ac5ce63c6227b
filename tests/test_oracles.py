"""Every query with SQL against DuckDB on the smallest tables; every other query runs."""

import os

import duckdb
import pytest

from tessella.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/**')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return connection


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, small, duck, name):
    found = registry.QUERIES[name](spark, small)
    want = duck.sql(registry.SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key) and got


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_runs_and_repeats(spark, small, name):
    once, again = (sorted(map(tuple, registry.QUERIES[name](spark, small).collect()), key=key) for _ in range(2))
    assert once and once == again
