"""Plans of every table that a query writes on its way, not only of the one it returns."""

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def written_plans(spark, monkeypatch, name):
    """Physical plans of what a query stages, and of its result."""
    plans, write = [], DataFrameWriter.parquet

    def record(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", record)
    out = entry.queries()[name](spark, FOLDER)
    return [*plans, out._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize("name", ["j1_points_in_tracts", "g6_outline_distance", "g4_nearest_place", "d12_savings", "d3_vintages_as_of",
                                  "s1_mixed_headings", "w1_file_order", "x8_sections", "t6_multivariate", "s12_named_files"])
def test_no_cross_join_on_the_way(spark, monkeypatch, name):
    plans = written_plans(spark, monkeypatch, name)
    assert plans
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "BatchEvalPython" not in plan and (name.startswith("t") or "InPandas" not in plan)


def test_only_needed_columns_are_read(spark, monkeypatch):
    """Facts are read with the columns that a search needs, and edges stay out of rows that need none."""
    plans = written_plans(spark, monkeypatch, "j1_points_in_tracts")
    scans = [line for plan in plans for line in plan.splitlines() if "lineitem" in line and "ReadSchema" in line]
    assert scans and all("l_extendedprice" not in line and "l_shipdate" not in line for line in scans)
