"""Wide emissions inventory."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airtoll import schemas as S
from airtoll.sources.tables import read_table


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory rows as text. Rows without a registry id belong to a hand-made summary block
    below the inventory, where the year columns mean other things; they are left out. Every column
    named like a year is kept."""
    kind = "parquet" if path.rstrip("/").lower().endswith(".parquet") else "csv"
    headings = spark.read.format(kind).option("header", True).load(path).columns
    years = [T.StructField(c, T.StringType()) for c in headings if re.fullmatch(r"\d{4}", c)]
    others = [f for f in S.INVENTORY.fields if f.name not in S.INVENTORY_YEARS]
    return read_table(spark, path, T.StructType([*others, *years])).filter(
        F.col("registry_id").isNotNull() & (F.trim("registry_id") != ""))
