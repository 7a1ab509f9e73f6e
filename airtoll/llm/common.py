"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtoll.sources.staging import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null stays null.

    lower() does the same wherever the text has single-byte characters only.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_ids(labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """(doc_id, label): per class the first per_class documents in the order of a hash of their id.

    Null ids and labels are left out, and so are documents whose rows disagree.
    """
    agreed = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & allowed)
              .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
              .where(F.col("label") == F.col("most")).select("doc_id", "label"))
    chosen = [agreed.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return chosen[0].unionByName(chosen[1])


def one_text_each(docs: DataFrame, ids: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, label, text) of the ids that docs has, one row each: of several texts the one with the least hash."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text")))
    return rows.groupBy("doc_id", "label").agg(least.alias("least")).select("doc_id", "label", "least.text")


def one_of_repeated(df: DataFrame, *keys: Column) -> DataFrame:
    """Of rows with the same keys the one whose columns come first as JSON, with all its columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*[k.alias(f"key {i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.to_json(row)).alias("first row")).select(
        *[F.col("first row").getField(c).alias(c) for c in df.columns])


def bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """Write once into the shared folder, bucketed by a column, and read back; grouping by it needs no shuffle.

    The catalog's entry goes at once (the files stay, as it names their folder), so nothing is left in it.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch_path(spark)).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved here: the plan holds files and buckets
    spark.sql(f"DROP TABLE {name}")
    return out
