"""Every registered query with SQL, against DuckDB on the smallest tables."""

import pytest
from oracle import compare, duck

from bandwright.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", ["AGG-30", "ARR-35", "JN-13", "MOD-8", "MOD-12", "MOD-22", "TGT-3", "TGT-6", "TOP-14", "WGT-4", "CMP-6", "GRD-2", "UDF-3"])
def test_runs_without_sql(spark, name):
    table = QUERIES[name](spark, SF).toArrow()
    assert table.num_rows > 0
