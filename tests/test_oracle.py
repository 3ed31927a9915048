"""Every registered query with SQL must give the same rows in DuckDB."""

import pytest
from compare import compare, open_tables
from conftest import SMALL

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return open_tables(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    problems, _, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SMALL)
    assert not problems, problems


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 50


def test_plans_have_no_cross_join(spark):
    for name in ("nearest_neighbours", "idw_estimates", "polygon_join", "place_features",
                 "scaled_labels", "prediction_grid", "raster_focal_statistics"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["hole_aggregates"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "o_totalprice" not in plan
