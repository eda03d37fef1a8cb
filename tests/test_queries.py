"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lotlens.plans import QUERIES, SQL


def plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6g}"
    return value if value is None or isinstance(value, (bool, int)) else str(value)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name: str, spark, duck, sf_dir: str) -> None:
    found = QUERIES[name](spark, sf_dir)
    wanted = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name: str, spark, sf_dir: str) -> None:
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark) -> None:
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
