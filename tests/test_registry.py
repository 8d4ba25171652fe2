"""Every registered query runs at the smallest scale and gives the rows of its SQL twin."""

import os

import pytest

from plenum.plans import registry
from plenum.sources.tables import table

DATA = os.environ.get("PLENUM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


#: Queries that join a table to one row.
ONE_ROW = {"g3_page_with_count", "a16_result_page", "d4_dry_run_report"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    """The twin's rows (some rows, without one), by a plan without cross joins."""
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert name in ONE_ROW or ("Cartesian" not in plan and "NestedLoop" not in plan)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_cut_queries_have_whole_ones():
    assert set(registry.CUT) <= set(registry.QUERIES) and set(registry.CUT.values()) <= set(registry.ORACLE_SQL)


def test_filters_reach_the_scan(spark):
    plan = table(spark, DATA, "orders").where("o_orderstatus = 'F'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "o_totalprice" not in plan
