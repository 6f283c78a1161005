"""Every registered query against its SQL in DuckDB, on whole tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from workload.oracle import ORACLE
from workload.queries import QUERIES

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def sf_dir():
    """Larger tables than elsewhere: the smallest ones have no cell whose last placement lacks a colour."""
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def sorted_rows(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    relation = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    expected = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    actual = [tuple(row) for row in df.select(*columns).collect()]
    assert actual, "no rows"
    assert sorted_rows(actual) == sorted_rows(expected)


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 3
