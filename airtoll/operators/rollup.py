"""Roll-ups of cases and cost, display tables, scenario savings and map tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.columns import category_values, clamp, column_label, exact_sum, fixed_text, rank_in, sum_or_zero
from airtoll.operators.demographics import county_of
from airtoll.operators.impact import add_unit_cost
from airtoll.sources.staging import staged

MILLION = 1e6


def case_summary(cases: DataFrame, scenario: str) -> DataFrame:
    """Positive case totals per (pollutant, endpoint, scenario)."""
    keys = ["pollutant", "endpoint", scenario]
    total = sum_or_zero(F.nanvl(F.col("additional_cases"), F.lit(None).cast("double")))
    return (
        cases.groupBy(*keys).agg(total.alias("total_additional_cases"))
        .filter(F.col("total_additional_cases") > 0)
    )


def cost_summary(cases: DataFrame, cost: DataFrame, scenario: str) -> DataFrame:
    """Case totals with unit cost and `total_cost`, one row per (pollutant, endpoint, scenario)."""
    return add_unit_cost(case_summary(cases, scenario), cost, "total_additional_cases", "total_cost")


def cost_by(priced: DataFrame, *keys: str) -> DataFrame:
    return priced.groupBy(*keys).agg(sum_or_zero(F.col("total_cost")).alias("total_cost"))


def cost_in_millions(priced: DataFrame, scenario: str) -> DataFrame:
    """Cost per scenario and pollutant in millions, with the legend rank of the pollutant."""
    return cost_by(priced, scenario, "pollutant").withColumn(
        "total_cost_million", F.col("total_cost") / MILLION
    ).withColumn("pollutant_rank", rank_in(F.col("pollutant"), S.LEGEND_ORDER))


def with_scenario_totals(priced: DataFrame, scenario: str = "condition") -> DataFrame:
    """Cost per (scenario, pollutant) and one row Total per scenario, by grouping sets.

    A missing pollutant stays apart from the total row.
    """
    return (
        priced.groupingSets([[F.col(scenario), F.col("pollutant")], [F.col(scenario)]],
                            F.col(scenario), F.col("pollutant"))
        .agg(F.grouping("pollutant").alias("is_total"), sum_or_zero(F.col("total_cost")).alias("total_cost"))
        .select(scenario,
                F.when(F.col("is_total") == 1, F.lit("Total")).otherwise(F.col("pollutant")).alias("pollutant"),
                "total_cost", (F.col("total_cost") / MILLION).alias("total_cost_million"))
    )


def control_ranges(priced: DataFrame) -> DataFrame:
    """Totals split into operations and controls, with the display ranks of both axes."""
    parts = F.split("condition", " ")
    return with_scenario_totals(priced).select(
        F.try_element_at(parts, F.lit(1)).alias("operations"),
        F.try_element_at(parts, F.lit(2)).alias("controls"),
        "pollutant", "total_cost", "total_cost_million",
    ).withColumn("pollutant_rank", rank_in(F.col("pollutant"), S.RANGE_ORDER)).withColumn(
        "controls_rank", rank_in(F.col("controls"), S.CONTROL_ORDER)
    ).withColumn("label", F.format_string("%.2f", F.round("total_cost_million", 2)))


def endpoint_trend(priced: DataFrame, scenario: str = "year") -> DataFrame:
    """Cases per scenario and endpoint; an endpoint outside the display order has a null rank."""
    return (
        priced.groupBy(scenario, "endpoint")
        .agg(sum_or_zero(F.col("total_additional_cases")).alias("total_cases"))
        .withColumn("endpoint_rank", rank_in(F.col("endpoint"), S.TREND_ORDER))
    )


def damage_wide(priced: DataFrame, scenario: str, first: Sequence[str | int] = ()) -> DataFrame:
    """Cases and cost (in millions) per pollutant and endpoint, one column per scenario and measure.

    Columns: the scenarios in `first`, then every other one in the data; a missing scenario is NA.
    `priced` (one row per pollutant, endpoint and scenario) is staged, as it is read twice.
    """
    priced = staged(priced)
    values = category_values(priced, scenario, first)

    def cell(measure: str, value: str | int | None) -> Column:
        return F.first(F.when(F.col(scenario).eqNullSafe(F.lit(value)), F.col(measure)), ignorenulls=True)

    cases = [cell("total_additional_cases", v).alias(f"total_additional_cases_{column_label(v)}") for v in values]
    costs = [(cell("total_cost", v) / MILLION).alias(f"total_cost_{column_label(v)}") for v in values]
    return priced.groupBy("endpoint", "pollutant").agg(*cases, *costs).withColumn(
        "pollutant_rank", rank_in(F.col("pollutant"), S.POLLUTANT_ORDER))


def damage_display(wide: DataFrame) -> DataFrame:
    """Text cells: three decimals for cases, one for millions, XX where there is no value."""

    def cell(name: str) -> Column:
        decimals = 3 if name.startswith("total_additional_cases") else 1
        return fixed_text(F.col(f"`{name}`"), decimals, "XX").alias(name)

    return wide.select("endpoint", "pollutant", "pollutant_rank",
                       *[cell(c) for c in wide.columns if c.startswith("total_")])


def in_display_order(df: DataFrame, *ranks: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in ranks])


# --- savings ----------------------------------------------------------------------------


def cost_per(tract_costs: DataFrame, *keys: str) -> DataFrame:
    return tract_costs.groupBy(*keys).agg(sum_or_zero(F.col("economic_cost")).alias("total_economic_cost"))


def scenario_savings(tract_costs: DataFrame, first: Sequence[str] = tuple(S.CONDITION_ORDER),
                     before: str = "Typical Uncontrolled", after: str = "Typical Controlled") -> DataFrame:
    """Cost per tract and condition side by side, and what control saves; null if one is missing.

    Columns: the conditions in `first`, then every other one in the data. The costs per tract and
    condition are staged, as they are read twice.
    """
    costs = staged(cost_per(tract_costs, "GEOID", "NAMELSADCO", "condition"))
    listed = [*first, *[c for c in (before, after) if c not in first]]

    def cost_of(condition: str | None) -> Column:
        chosen = F.col("condition").eqNullSafe(F.lit(condition))
        return F.first(F.when(chosen, F.col("total_economic_cost")), ignorenulls=True).alias(
            f"economic_cost_{column_label(condition)}")

    wide = costs.groupBy("GEOID", "NAMELSADCO").agg(*[cost_of(c) for c in category_values(costs, "condition", listed)])
    return wide.withColumn(
        "delta_economic_cost", F.col(f"`economic_cost_{before}`") - F.col(f"`economic_cost_{after}`"))


# --- map tables -------------------------------------------------------------------------


def county_damages(counties: DataFrame, tract_costs: DataFrame) -> DataFrame:
    """Every county with its cost; a county without cases keeps a null cost."""
    totals = cost_per(tract_costs, "county_fips").withColumnRenamed("county_fips", "GEOID")
    return counties.join(totals, "GEOID", "left")


def tract_damages(tracts: DataFrame, tract_costs: DataFrame, county: str) -> DataFrame:
    """Every given tract (those of one county) with its cost."""
    totals = cost_per(tract_costs.filter(F.col("county_fips") == county), "GEOID")
    return tracts.join(totals, "GEOID", "left")


def county_savings_rows(counties: DataFrame, savings: DataFrame) -> DataFrame:
    """County shapes joined to tract savings by county name: one row per tract of the county."""
    named = savings.withColumnRenamed("NAMELSADCO", "NAMELSAD")
    return counties.drop("GEOID").join(named, "NAMELSAD", "left")


def county_savings(counties: DataFrame, savings: DataFrame) -> DataFrame:
    """County savings proper: the sum over its tracts by county id, so that equal names stay apart."""
    totals = savings.groupBy(county_of(F.col("GEOID")).alias("GEOID")).agg(
        exact_sum(F.col("delta_economic_cost")).alias("delta_economic_cost"))
    return counties.join(totals, "GEOID", "left")


def tract_savings(tracts: DataFrame, savings: DataFrame) -> DataFrame:
    return tracts.join(savings.select("GEOID", "delta_economic_cost"), "GEOID")


def map_value(cost: Column, high: float | None = None, transform: str = "sqrt") -> Column:
    """Value behind a map colour: millions, squeezed into [0, high], then sqrt or log10."""
    value = cost / MILLION
    if high is not None:
        value = clamp(value, 0.0, high)
    return F.sqrt(value) if transform == "sqrt" else F.log10(value)
