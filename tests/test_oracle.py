"""Every named query against its DuckDB statement at sf0.01 (the scale the driver checks)."""

import os
import sys

import pytest

from conftest import SF01 as SF_ORACLE

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import _rows, duck  # noqa: E402

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_is_registered_with_a_callable():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 30


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    sp = QUERIES[name](spark, SF_ORACLE).toPandas()
    dk = con.execute(SQL[name]).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["ticker", "date"]
    assert df.count() > 0
