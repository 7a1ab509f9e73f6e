"""Checks of run logs, scenario coverage and land-surface tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.columns import join_null_safe

FLOWS = list(range(10, 361, 10))


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def run_completeness(days: DataFrame, run: Sequence[str] = ("file_name",)) -> DataFrame:
    """One row per run: days expected and seen, repeats, closing line, complete or not."""
    # counted per calendar day first: what is left of a run is bounded by the calendar
    counted = days.groupBy(*run, "year", "day").agg(F.count("day").alias("lines"), F.bool_or("closing").alias("closing"))
    seen = counted.groupBy(*run).agg(
        F.max("year").alias("year"), F.size(F.collect_set("year")).cast("long").alias("years"),
        F.sum("lines").alias("day_lines"), F.size(F.collect_set("day")).cast("long").alias("days"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.bool_or("closing").alias("closed"))
    expected = days_in_year(F.col("year"))
    return seen.withColumn("expected_days", expected).withColumn(
        "complete", F.coalesce((F.col("days") == expected) & (F.col("day_lines") == expected)
                               & (F.col("first_day") == 1) & (F.col("last_day") == expected)
                               & (F.col("years") == 1) & F.col("closed"), F.lit(False)))


def run_gaps(days: DataFrame, run: Sequence[str] = ("file_name",), day: str = "day") -> DataFrame:
    """Gaps between consecutive days of a run: the last day before and the first day after.

    A run has at most one distinct day per calendar day, so its window is small.
    """
    distinct = days.filter(F.col(day).isNotNull()).select(*run, day).distinct()
    before = F.lag(day).over(Window.partitionBy(*run).orderBy(day))
    return distinct.withColumn("gap_after", before).filter(F.col(day) - F.col("gap_after") > 1).select(
        *run, "gap_after", F.col(day).alias("gap_before"),
        (F.col(day) - F.col("gap_after") - 1).alias("missing_days"))


def missing_runs(manifest: DataFrame, expected: Sequence[str] = tuple(S.POLLUTANT_ORDER),
                 keys: Sequence[str] = ("facility", "scenario")) -> DataFrame:
    """(keys, pollutant) that are expected for every scenario but have no run."""
    wanted = manifest.select(*keys).distinct().withColumn(
        "pollutant", F.explode(F.array(*[F.lit(p) for p in expected])))
    return wanted.join(manifest.select(*keys, "pollutant"), [*keys, "pollutant"], "left_anti")


def site_characteristics(bounds: DataFrame, values: DataFrame) -> DataFrame:
    """Sector bounds with albedo, Bowen ratio and roughness per report."""
    return bounds.join(values.drop("site", "year"), ["file_name", "sector"]).select(
        "site", "year", "sector", "start_dir", "end_dir", "albedo", "bowen", "roughness")


def annual_roughness(monthly: DataFrame, values: DataFrame, tolerance: float = 0.0005 + 1e-9) -> DataFrame:
    """Mean of the monthly values per site, year and sector against the published annual value."""
    keys = ["site", "year", "sector"]
    mean = monthly.groupBy(*keys).agg(
        F.avg("roughness").alias("monthly_mean"), F.count("roughness").alias("months"))
    annual = values.select(*keys, F.col("roughness").alias("annual"))
    return join_null_safe(mean, annual, keys).withColumn(
        "agrees", F.abs(F.col("monthly_mean") - F.col("annual")) <= tolerance)


def cover_check(counts: DataFrame) -> DataFrame:
    """Sum of the classes per site, year and sector against its Total row."""
    total = F.col("class") == -1
    return counts.groupBy("site", "year", "sector").agg(
        F.coalesce(F.sum(F.when(~total, F.col("cells"))), F.lit(0)).alias("class_sum"),
        F.max(F.when(total, F.col("cells"))).alias("total"),
        F.sum(F.when(~total, 1).otherwise(0)).alias("classes"),
    ).withColumn("agrees", F.col("class_sum") == F.col("total"))


def roughness_change(values: DataFrame, site: Sequence[str] = ("site",)) -> DataFrame:
    """Change of the roughness of a sector of a site since the report before."""
    before = Window.partitionBy(*site, "sector").orderBy("year")
    return values.select(*site, "year", "sector", "roughness").withColumns({
        "previous_year": F.lag("year").over(before),
        "change": F.col("roughness") - F.lag("roughness").over(before)})


def wind_sector(readings: DataFrame, sectors: DataFrame, direction: str = "direction") -> DataFrame:
    """Sector [start, end) of each wind direction; 360 counts as 0 and a sector may pass north.

    Sectors are spread over whole degrees, so the range join is an equi-join on the degree.
    """
    width = F.col("end_dir") - F.col("start_dir")
    width = F.when(width <= 0, width + 360).otherwise(width)
    degrees = F.explode(F.sequence(F.floor("start_dir"), F.ceil(F.col("start_dir") + width) - 1))
    spread = sectors.select("sector", "start_dir", width.alias("width"), degrees.alias("degree")).withColumn(
        "degree", F.pmod("degree", F.lit(360))).distinct()
    turned = F.pmod(F.col(direction), F.lit(360.0))
    rows = readings.withColumn("turned", turned).withColumn("degree", F.floor("turned").cast("long"))
    # the offset test on the left side keeps readings outside every sector
    inside = F.pmod(F.col("turned") - F.col("start_dir"), F.lit(360.0)) < F.col("width")
    matches = F.col("left.degree") == F.col("right.degree")
    return rows.alias("left").join(spread.alias("right"), matches & inside, "left").select(
        *[F.col(f"left.`{c}`") for c in readings.columns], "sector")


def flow_audit(events: DataFrame) -> DataFrame:
    """Per downwash log: distinct wind flows, the missing ones, grouped structures, end line."""
    per_run = events.groupBy("file_name").agg(
        F.array_sort(F.collect_set("flow")).alias("flows"),
        F.bool_or("grouped").alias("grouped"), F.bool_or("ended").alias("ended"))
    wanted = F.array(*[F.lit(f) for f in FLOWS])
    missing = F.array_sort(F.array_except(wanted, F.col("flows")))
    return per_run.select("file_name", F.size("flows").alias("flow_count"), missing.alias("missing_flows"),
                          "grouped", "ended").withColumn(
        "complete", (F.size("missing_flows") == 0) & F.col("ended"))
