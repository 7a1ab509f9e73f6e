"""Emissions inventory: long form, criteria pollutants, tons."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.columns import number

POUNDS_PER_TON = 2000


def unpivot_inventory(inventory: DataFrame, years: Sequence[str] | None = None) -> DataFrame:
    """(ids, year, pounds) without blanks and text NA; by default every column named like a year is one."""
    if years is None:
        years = [c for c in inventory.columns if re.fullmatch(r"\d{4}", c)]
    ids = [c for c in inventory.columns if c not in years]
    return (
        inventory.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{y}`") for y in years], "year", "value")
        .withColumn("year", F.col("year").cast("int"))
        .withColumn("pounds", number(F.trim("value"))).drop("value").filter(F.col("pounds").isNotNull())
    )


def criteria_summary(long: DataFrame, ids: Sequence[str] = ("registry_id",)) -> DataFrame:
    """Listed pollutants under their short names, pounds and short tons per year."""
    names = F.create_map(*[F.lit(v) for pair in S.CRITERIA_OF_INVENTORY.items() for v in pair])
    return (
        long.withColumn("short_name", F.try_element_at(names, F.col("pollutant_name")))
        .filter(F.col("short_name").isNotNull())
        .groupBy(*ids, "short_name", "year").agg(F.sum("pounds").alias("pounds"))
        .withColumn("tons", F.col("pounds") / POUNDS_PER_TON)
    )


def particulate_total(summary: DataFrame, ids: Sequence[str] = ("registry_id",)) -> DataFrame:
    """PM2.5 tons plus PM10 tons per year, as published; PM10 contains PM2.5."""
    return summary.filter(F.col("short_name").isin("PM2.5", "PM10")).groupBy(*ids, "year").agg(
        F.sum("tons").alias("pm_total_tons"))
