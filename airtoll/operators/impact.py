"""Attributable cases and their cost per tract, pollutant, endpoint and scenario."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.columns import join_null_safe, recode
from airtoll.functions.epidemiology import attributable_cases, rate_per_person, response_coefficient


def latest_rates(rates: DataFrame) -> DataFrame:
    """Rows of the latest year, without the year; missing years are ignored."""
    newest = rates.agg(F.max("year").alias("year"))
    return rates.join(newest, "year", "left_semi").drop("year")


def add_rates(exposed: DataFrame, rates: DataFrame, on: Sequence[str] = ("county_fips",),
              missing_rates: str = "keep") -> DataFrame:
    """Baseline rates by county, or by county and year.

    missing_rates='keep' leaves counties without rates with null rates, 'drop' removes them.
    Totals agree, the tract table differs.
    """
    how = {"keep": "left", "drop": "inner"}[missing_rates]
    return exposed.join(rates, list(on), how)


def unpivot_rates(exposed: DataFrame, names: Mapping[str, str] = S.ENDPOINT_OF_RATE) -> DataFrame:
    """Every `*_rate` column to a row (endpoint, rate); null rates are kept."""
    rates = [c for c in exposed.columns if c.endswith("_rate")]
    ids = [c for c in exposed.columns if c not in rates]
    as_text = exposed.withColumns({c: F.col(c).cast("string") for c in rates})
    return as_text.unpivot(ids, rates, "endpoint", "rate").withColumn("endpoint", recode(F.col("endpoint"), names))


def tract_cases(exposed: DataFrame, risk: DataFrame) -> DataFrame:
    """Cases per tract, pollutant, scenario and endpoint; null where any input is missing."""
    rows = join_null_safe(unpivot_rates(exposed), risk, ["pollutant", "endpoint"], "left")
    return (
        rows.withColumn("beta", response_coefficient(F.col("RR")))
        .withColumn("baseline_rate", rate_per_person(F.col("rate")))
        .withColumn("additional_cases", attributable_cases(
            F.col("baseline_rate"), F.col("total_pop"), F.col("beta"), F.col("Final_Conc")))
    )


def add_unit_cost(cases: DataFrame, cost: DataFrame, count: str = "additional_cases",
                  name: str = "economic_cost") -> DataFrame:
    """Unit cost by endpoint (under another name in the cost table) and the product."""
    priced = join_null_safe(cases, cost.withColumnRenamed("Health Endpoint", "endpoint"), ["endpoint"], "left")
    return priced.withColumn(name, F.col(count) * F.col("Economic Cost"))
