"""Demographic tables: pivot, wide form, vintages, joins to concentrations."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.columns import category_values


def widen_demographics(rows: DataFrame, names: Sequence[str] = tuple(S.DEMOGRAPHICS)) -> DataFrame:
    """Long rows (GEOID, NAME, variable, estimate, moe, year) to one column per variable; of several estimates the least.

    One aggregation and one shuffle, of a row per tract and year, where a pivot sends a row per variable and groups twice.
    """
    return rows.groupBy("GEOID", "NAME", "year").agg(*[
        F.min(F.when(F.col("variable") == name, F.col("estimate"))).alias(name) for name in names])


def spread_vintages(rows: DataFrame, years: Sequence[int], most_years: int | None = None, key: str = "GEOID") -> DataFrame:
    """rows for each of the years: per key those of its latest release that is not after the year, with that release as `vintage`.

    A release stands for the years up to the next one of its key, so every row is unfolded to the wanted years that
    it covers; no range join is made, and the window only looks for the next release of a key. A release more than
    most_years old is not used. A year before a key's first release has no row.
    """
    later = Window.partitionBy(key).orderBy("year").rangeBetween(1, Window.unboundedFollowing)
    wanted = F.array(*[F.lit(int(y)) for y in sorted(set(years))]).cast("array<int>")

    def covered(year: Column) -> Column:
        stands = (year >= F.col("vintage")) & (F.col("__next").isNull() | (year < F.col("__next")))
        return stands if most_years is None else stands & (year - F.col("vintage") <= most_years)

    return (rows.withColumn("__next", F.min("year").over(later)).withColumnRenamed("year", "vintage")
            .withColumn("year", F.explode(F.filter(wanted, covered))).select(*rows.columns, "vintage"))


def add_demographics_as_of(concentrations: DataFrame, demographics: DataFrame, most_years: int | None = None) -> DataFrame:
    """Left join by tract with the latest release not after the scenario year, and its year as `vintage`."""
    years = [y for y in category_values(concentrations, "year") if y is not None]
    return add_demographics(concentrations, spread_vintages(demographics, years, most_years), ["GEOID", "year"])


def copy_vintage(rows: DataFrame, source: int = 2023, target: int = 2024) -> DataFrame:
    """Use the rows of one year for a later year without a release of its own.

    Rows that already carry the target year are not used. Nothing is added when the source
    year is absent. One scan: each source row is written twice. spread_vintages() is the general
    form; for one pair known beforehand no window over the releases is needed.
    """
    years = (
        F.when(F.col("year") == source, F.array(F.lit(source), F.lit(target)))
        .when(F.col("year") == target, F.array().cast("array<int>"))
        .otherwise(F.array(F.col("year").cast("int")))
    )
    columns = rows.columns
    return rows.withColumn("__year", F.explode(years)).drop("year").withColumnRenamed(
        "__year", "year").select(*columns)


def drop_margins(wide: DataFrame) -> DataFrame:
    """Drop the margin-of-error columns: names that end in M, in either case."""
    return wide.drop(*[c for c in wide.columns if c.lower().endswith("m")])


def strip_estimate_suffix(wide: DataFrame, names: Sequence[str] = tuple(S.DEMOGRAPHICS)) -> DataFrame:
    """total_popE -> total_pop and so on; other columns that end in E keep their name."""
    return wide.withColumnsRenamed(
        {c: re.sub("E$", "", c) for c in wide.columns if re.sub("E$", "", c) in names})


def county_of(geoid: Column) -> Column:
    return F.substring(geoid, 1, 5)


def add_demographics(concentrations: DataFrame, demographics: DataFrame,
                     on: Sequence[str] = ("GEOID",)) -> DataFrame:
    """Left join by tract, or by tract and year; the county id comes from the tract id.

    Concentrations keep their own NAME. Tracts without demographics keep null counts. Demographics have a row per
    tract (and year) and are unfolded from smaller files, so their estimated size does not decide on a broadcast.
    """
    joined = concentrations.withColumn("GEOID", F.col("GEOID").cast("string")).join(
        demographics.drop("NAME").hint("merge"), list(on), "left")
    return joined if "county_fips" in joined.columns else joined.withColumn(
        "county_fips", county_of(F.col("GEOID")))


def unmatched_tracts(concentrations: DataFrame, demographics: DataFrame,
                     on: Sequence[str] = ("GEOID",)) -> DataFrame:
    """Rows per scenario year whose tract has no demographics; they vanish from every sum."""
    others = [c for c in on if c != "GEOID"]
    missing = concentrations.join(demographics.select(*on).hint("merge"), list(on), "left_anti")
    return missing.groupBy(*others).agg(F.count(F.lit(1)).alias("unmatched_rows"),
                                        F.countDistinct("GEOID").alias("unmatched_tracts"))

