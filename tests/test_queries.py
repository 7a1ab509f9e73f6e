"""Registered queries: names, results on the smallest tables and plan shapes."""

import contextlib
import io

import duckdb
import pytest

import __spark_entry__ as entry
from airtoll.plans import catalogue, oracles
from check_queries import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
COMPARED = ["d10_cost_by_pollutant", "d12_savings", "w1_monitor_ids", "g7_assign_concentration", "t1_univariate", "t6_multivariate",
            "t10_formatted", "d13_county_savings", "x5_run_completeness", "x8_annual_roughness", "x5_run_gaps", "x9_cover_check"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(oracles.all_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 15


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, duck, name):
    got = canonical(entry.queries()[name](spark, FOLDER).toPandas())
    want = canonical(duck.execute(entry.oracle_sql()[name]).df())
    assert got.equals(want)


def test_sums_of_parts(spark):
    table = {(r["condition"], r["pollutant"]): r["total_cost"]
             for r in entry.queries()["a9_subtotals"](spark, FOLDER).collect()}
    for condition in {c for c, _ in table}:
        parts = sum(v for (c, p), v in table.items() if c == condition and p != "Total")
        assert parts == pytest.approx(table[(condition, "Total")], rel=1e-9)


@pytest.mark.parametrize("name", ["d10_cost_by_pollutant", "j2_nearest_receptor", "d13_savings_map", "x6_coverage",
                                  "x11_sector", "t6_multivariate", "d1_monitor_table", "j7_rates_latest_inner"])
def test_no_cross_join_in_the_plan(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        entry.queries()[name](spark, FOLDER).explain()
    plan = text.getvalue()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ArrowEvalPython" not in plan or name.startswith("t")
