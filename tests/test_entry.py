"""The entry points: queries agree with their SQL over the driver's smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver
from srcgraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "documents", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = driver.queries()[name](spark, SF)
    columns = sorted(got.columns)
    result = duck.execute(driver.oracle_sql()[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    want = [tuple(r[at.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns[:3] == ["path", "name", "callee"] and frame.count() > 0


def test_every_query_is_registered():
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
