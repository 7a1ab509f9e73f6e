import pytest
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.operators import receptors as R
from tests.conftest import rows
from tests.test_functions import forward

HEAD = S.CONCENTRATION_HEADING


def keys_of(spark, name):
    df = spark.createDataFrame([(name,)], "n string")
    year, condition = R.year_keys(F.col("n")), R.condition_keys(F.col("n"), "Plant")
    return tuple(df.select(year["year"], year["pollutant"], condition["condition"], condition["pollutant"]).first())


@pytest.mark.parametrize("name,expected", [
    ("reformatted_Plant 2017 PM Annual.csv", (2017, "PM", "2017", "PM")),
    ("reformatted_Plant Typical Controlled SO2 Annual.csv", (None, None, "Typical Controlled", "SO2")),
    ("Plant 2020 NOx Annual.csv", (2020, "NOx", None, None)),
    ("notes.csv", (None, None, None, None)),
])
def test_scenario_keys(spark, name, expected):
    assert keys_of(spark, name) == expected


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "x int, `no value` string, y string")
    assert R.drop_empty_columns(df).columns == ["x", "y"]


def grid(spark, *rows_):
    return spark.createDataFrame(list(rows_), f"X double, Y double, `{HEAD}` double, file_name string")


def test_monitor_ids_follow_file_and_position(spark):
    df = grid(spark, (2.0, 1.0, 5.0, "a.csv"), (1.0, 1.0, 6.0, "a.csv"), (9.0, 0.0, 7.0, "a.csv"), (0.0, 0.0, 8.0, "b.csv"))
    got = rows(R.monitor_ids(df).select("file_name", "Monitor Name", HEAD), "file_name", "Monitor Name")
    assert got == [("a.csv", "M001", 7.0), ("a.csv", "M002", 6.0), ("a.csv", "M003", 5.0), ("b.csv", "M101", 8.0)]


def test_row_numbers_with_a_hot_file_and_copies(spark):
    """One file holds most rows, most of them on one line, and one row is repeated beyond a chunk."""
    df = spark.range(40000).select(
        F.when(F.col("id") < 30000, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))).alias("file_name"),
        F.when(F.col("id") < 25000, 7.0).otherwise((F.col("id") % 997).cast("double")).alias("X"),
        F.when(F.col("id") < 28000, 3.0).otherwise((F.col("id") % 13).cast("double")).alias("Y"))
    numbered = R.number_rows(df, ["file_name"], ["Y", "X"], 2000).toPandas()
    for _, part in numbered.groupby("file_name"):
        part = part.sort_values("row_number")
        assert list(part["row_number"]) == list(range(1, len(part) + 1))
        places = list(zip(part["Y"], part["X"], strict=True))
        assert places == sorted(places)
    assert len(numbered) == 40000


def test_rows_without_position_come_last(spark):
    df = grid(spark, (None, None, 1.0, "a.csv"), (3.0, 2.0, 2.0, "a.csv"), (None, 2.0, 3.0, "a.csv"))
    got = rows(R.monitor_ids(df).select("Monitor Name", HEAD), "Monitor Name")
    assert got == [("M001", 2.0), ("M002", 3.0), ("M003", 1.0)]


def test_reformat_receptors(spark):
    x, y = forward(-76.5, 39.25)
    df = grid(spark, (x, y, 0.5, "Plant 2017 PM Annual.csv"), (None, y, 1.0, "Plant 2017 PM Annual.csv"),
              (x + 900, y, None, "Plant 2017 PM Annual.csv"))
    got = rows(R.reformat_receptors(df), "Monitor Name")
    assert R.reformat_receptors(df).columns == ["file_name", *S.MONITOR_COLUMNS]
    assert [r[1] for r in got] == ["M001", "M002"]
    assert got[0][2:] == ("Unknown", pytest.approx(39.25, abs=1e-7), pytest.approx(-76.5, abs=1e-7),
                          "D24HourMean", "Annual", "Mean", 0.5)
    places = spark.createDataFrame([("Harbour", -76.49, 39.25), ("Hills", -78.0, 39.6)],
                                   "place string, longitude double, latitude double")
    assert {r["Monitor Description"] for r in R.reformat_receptors(df, places=places).collect()} == {"Harbour"}
