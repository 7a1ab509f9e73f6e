"""Receptor grids to monitor tables: scenario keys, empty columns, numbering, reprojection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtoll import schemas as S
from airtoll.functions.columns import join_null_safe, matched
from airtoll.functions.geodesy import utm_to_lon_lat, zone_of_epsg
from airtoll.operators.spatial import Grid, nearest_place
from airtoll.sources.staging import staged

IDS_PER_FILE = 100  # first id of file i is i * 100 + 1


def year_keys(file_name: Column) -> dict[str, Column]:
    """`<anything> <year> <pollutant> Annual.csv`; null where the name does not match."""
    year = F.regexp_substr(file_name, F.lit(r"\d{4}"))
    pattern = r"^(?:(?!\d{4}).)*\d{4}\s(.*?)\sAnnual\.csv"
    return {"year": year.try_cast("int"), "pollutant": matched(file_name, pattern, 1)}


def condition_keys(file_name: Column, facility: str = r"\S+") -> dict[str, Column]:
    """`reformatted_<facility> <condition> <pollutant> Annual.csv`; null without a match."""
    pattern = rf"reformatted_{facility}\s(.*?)\s(\S+)\sAnnual\.csv"
    return {"condition": matched(file_name, pattern, 1), "pollutant": matched(file_name, pattern, 2)}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without any value; one counting pass decides the schema."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if counts[i] > 0])


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str],
                rows_per_part: int = 1_000_000) -> DataFrame:
    """Row numbers 1..n inside each group without gathering a group in one task; nulls come last.

    Adds `row_number` and `group_number`, the rank of the group. The rows travel once: they are dealt by ranges of
    (group, order, all other columns), as many as their number asks for, sorted there and staged with their place in the
    range; every range of a group starts where the ranges before it end. Rows that are equal in every column are
    interchangeable and take consecutive numbers; their place in the input tells them apart, so that a heavily repeated
    row is dealt to several ranges. Only a row per range and group is summed up, and the list of groups (files) is ranked
    as a whole.
    """
    columns = df.columns
    wanted = [F.col(f"`{c}`").asc_nulls_last()
              for c in (*group, *order, *[c for c in columns if c not in order and c not in group])]
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_part))
    dealt = df.withColumn("__copy", F.monotonically_increasing_id()).repartitionByRange(
        ranges, *wanted, "__copy").sortWithinPartitions(*wanted, "__copy").drop("__copy")
    dealt = staged(dealt.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}))
    sizes = dealt.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__size"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "__range", (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first") + 1).alias("__start"))
    names = sizes.select(*group).distinct().withColumn("group_number", F.row_number().over(Window.orderBy(*group)))
    # few rows, which the estimate of an aggregate does not tell: staged, so that the dealt rows stay where they are
    starts = staged(join_null_safe(starts, names, group))
    return join_null_safe(dealt, starts, [*group, "__range"]).select(
        *[F.col(f"`{c}`") for c in columns], "group_number", (F.col("__place") + F.col("__start")).alias("row_number"))


def monitor_ids(receptors: DataFrame, files: Sequence[str] = ("file_name",)) -> DataFrame:
    """Sequential monitor names per file in (Y, X) order, `M%03d` from i * 100 + 1 for file i.

    Ids of neighbouring files overlap once a file has more than 100 rows, so the file stays
    part of the key. Files are ranked by name.
    """
    numbered = number_rows(receptors, files, ["Y", "X"])
    number = (F.col("group_number") - 1) * IDS_PER_FILE + F.col("row_number")
    text = number.cast("string")
    padded = F.when(number < 1000, F.lpad(text, 3, "0")).otherwise(text)
    return numbered.withColumn("Monitor Name", F.concat(F.lit("M"), padded)).drop("group_number", "row_number")


def monitor_ids_in_order(receptors: DataFrame, files: Sequence[str] = ("file_name",), position: str = "row_number") -> DataFrame:
    """Monitor names by the place of a row in its file (from 1), as the files stand: `M%03d` from i * 100 + 1 for file i.

    The place comes from the scan, so nothing is sorted; only the names of files are ranked.
    """
    names = receptors.select(*files).distinct().withColumn("__file", F.row_number().over(Window.orderBy(*files)))
    numbered = join_null_safe(receptors, names, files)
    text = ((F.col("__file") - 1) * IDS_PER_FILE + F.col(position)).cast("string")
    padded = F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    return numbered.withColumn("Monitor Name", F.concat(F.lit("M"), padded)).drop("__file", position)


def reformat_receptors(receptors: DataFrame, epsg: int = 32618, places: DataFrame | None = None,
                       place_grid: Grid | None = None) -> DataFrame:
    """Raw grids (X, Y, concentration, file_name) to monitor tables, all files at once.

    Rows that tell their place in the file (`row_number`) are numbered by it, others in (Y, X) order.
    `places` (place, longitude, latitude) stands in for a reverse geocoder: a site is described
    by its nearest place, or as unknown where no gazetteer is given.
    """
    zone, south = zone_of_epsg(epsg)
    lon, lat = utm_to_lon_lat(F.col("X"), F.col("Y"), zone, south)
    placed = receptors.filter(F.col("X").isNotNull() & F.col("Y").isNotNull())
    numbered = monitor_ids_in_order(placed) if "row_number" in placed.columns else monitor_ids(placed)
    if places is None:
        sites = numbered.withColumn("Monitor Description", F.lit(S.UNKNOWN_PLACE))
    else:
        spots = placed.select("X", "Y").distinct().select("X", "Y", lon.alias("Longitude"), lat.alias("Latitude"))
        named = nearest_place(spots, places, ["X", "Y"], place_grid)
        sites = numbered.join(named, ["X", "Y"], "left").withColumn(
            "Monitor Description", F.coalesce("place", F.lit(S.UNKNOWN_PLACE)))
    return sites.withColumns(
        {"Longitude": lon, "Latitude": lat} | {name: F.lit(value) for name, value in S.MONITOR_CONSTANTS.items()}
        | {"Values": F.col(f"`{S.CONCENTRATION_HEADING}`")}
    ).select("file_name", *[F.col(f"`{c}`") for c in S.MONITOR_COLUMNS])
