"""Latest releases per scenario year, and sums that don't depend on partitions."""

import math
import random
import struct
from fractions import Fraction

from pyspark.sql import functions as F

from airtoll.functions.columns import exact_sum, sum_or_zero
from airtoll.operators import demographics as D
from airtoll.operators import rollup as U
from tests.conftest import rows


def test_latest_release_by_brute_force(spark):
    r = random.Random(7)
    released = {(f"{g:02d}", y): float(r.randrange(1000)) for g in range(40) for y in range(1990, 2025) if r.random() < 0.15}
    wanted = [(f"{g:02d}", y, "PM") for g in range(42) for y in (1989, 1995, 2003, 2004, 2024, None)]
    people = spark.createDataFrame([(g, "n", y, v) for (g, y), v in released.items()], "GEOID string, NAME string, year int, total_pop double")
    air = spark.createDataFrame(wanted, "GEOID string, year int, pollutant string")
    for most in (None, 0, 3):
        got = {(x["GEOID"], x["year"]): (x["vintage"], x["total_pop"]) for x in D.add_demographics_as_of(air, people, most).collect()}
        assert len(got) == len(wanted)
        for g, y, _ in wanted:
            older = [v for (k, v) in released if k == g and y is not None and v <= y and (most is None or y - v <= most)]
            assert got[g, y] == ((max(older), released[g, max(older)]) if older else (None, None))


def test_copied_vintage_is_a_case_of_the_latest_release(spark):
    people = spark.createDataFrame([("1", "n", 2020, 1.0), ("1", "n", 2023, 2.0), ("2", "n", 2020, 3.0), ("3", "n", 2023, 4.0)],
                                   "GEOID string, NAME string, year int, total_pop double")
    copied = D.copy_vintage(people).filter("year = 2024")
    spread = D.spread_vintages(people, [2024], most_years=1).drop("vintage")
    assert rows(copied, "GEOID") == rows(spread, "GEOID") and spread.count() == 2


def bits(x):
    return struct.pack("<d", x)


def test_totals_are_equal_bit_by_bit(spark):
    r = random.Random(3)
    values = [r.choice([1, -1]) * r.random() * 10 ** r.uniform(-12, 12) for _ in range(3000)] + [0.1] * 500 + [1e15, -1e15, 2.0 ** -60, None]
    data = [(i % 3, v) for i, v in enumerate(values)]
    found = []
    for n in (1, 4, 37):
        r.shuffle(data)
        df = spark.createDataFrame(data, "k int, v double").repartition(n)
        found.append({x["k"]: bits(x["s"]) for x in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()})
    assert found[0] == found[1] == found[2]
    for k in range(3):
        exact = sum(Fraction(v) for key, v in data if key == k and v is not None)
        assert math.isclose(struct.unpack("<d", found[0][k])[0], float(exact), rel_tol=1e-15, abs_tol=1e-15)


def test_totals_of_cost_are_equal_bit_by_bit(spark):
    r = random.Random(4)
    data = [(r.choice("ab"), r.choice(["PM", "SO2"]), r.random() * 1e6) for _ in range(4000)]
    found = set()
    for n in (1, 4, 37):
        priced = spark.createDataFrame(data, "condition string, pollutant string, total_cost double").repartition(n)
        found.add(tuple(sorted((x["condition"], x["pollutant"], bits(x["total_cost"])) for x in U.with_scenario_totals(priced).collect())))
    assert len(found) == 1


def test_odd_values(spark):
    def total(*values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v")), sum_or_zero(F.col("v"))).first()

    assert total(None, None) == (None, 0.0) and total(1.5, None, -0.5) == (1.0, 1.0) and total(-1e-3)[0] == -1e-3
    assert math.isnan(total(1.0, math.nan)[0]) and total(1.0, math.inf)[0] == math.inf and total(1e300, 1.0)[0] == 1e300
    assert total(-2.0 ** -30, 2.0 ** -30)[0] == 0.0 and total(*[0.1] * 10)[0] == 1.0 and total(2.0 ** 74, 1.0, -(2.0 ** 74))[0] == 1.0
