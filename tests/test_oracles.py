"""Every registered query of the engine against its SQL, on the generated tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from coinloom.plans import queries as own


def value(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 6) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = own.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = duck.execute(own.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = own.QUERIES[name](spark, sf_dir)
    assert df.columns
    df.collect()
