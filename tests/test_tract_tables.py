"""Tables with a row per tract: dealt before they are unfolded, widened in one shuffle, not broadcast by a guessed size."""

from airtoll.operators import demographics as D
from airtoll.plans import bindings as B

FOLDER = "/root/testdata/sf0.001"
LONG = "GEOID string, NAME string, variable string, estimate double, moe double, year int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_customers_are_dealt_before_they_are_unfolded(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts > 1 and B.table(spark, FOLDER, "customer").rdd.getNumPartitions() == 1
    assert B.demographics_long(spark, FOLDER).rdd.getNumPartitions() == parts
    assert plan_of(D.widen_demographics(B.demographics_long(spark, FOLDER))).count("Exchange hashpartitioning(GEOID") == 1


def test_widened_rows_of_odd_tables(spark):
    long = spark.createDataFrame([
        ("a", "n", "white", 2.0, 0.1, 2000), ("a", "n", "white", 1.0, 0.1, 2000), ("a", "n", "black", None, 0.1, 2000),
        ("a", "n", "other", 9.0, 0.1, 2000), ("b", None, "other", 9.0, 0.1, 2000), (None, "n", None, 3.0, 0.1, None),
        (None, "n", "white", 4.0, 0.1, None)], LONG)
    got = D.widen_demographics(long, ["white", "black"])
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    assert got.columns == ["GEOID", "NAME", "year", "white", "black"]
    assert {tuple(r) for r in got.collect()} == {
        ("a", "n", 2000, 1.0, None), ("b", None, 2000, None, None), (None, "n", None, 4.0, None)}


def test_demographics_are_not_broadcast(spark):
    air = spark.createDataFrame([("a", "PM", 2000, 1.5), ("b", "PM", 2000, 2.5)], "GEOID string, pollutant string, year int, Final_Conc double")
    people = spark.createDataFrame([("a", "n", 2000, 7.0)], "GEOID string, NAME string, year int, total_pop double")
    joined = D.add_demographics(air, people, ["GEOID", "year"])
    missing = D.unmatched_tracts(air, people, ["GEOID", "year"])
    assert "Broadcast" not in plan_of(joined) + plan_of(missing)
    assert {(r["GEOID"], r["total_pop"]) for r in joined.collect()} == {("a", 7.0), ("b", None)}
    assert [tuple(r) for r in missing.collect()] == [(2000, 1, 1)]
