"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """One table; facilities share a path as partitions instead of overwriting one file."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    writer.partitionBy(*partition_by).format(fmt).save(path)


def write_reformatted(monitors: DataFrame, path: str, fmt: str = "csv") -> None:
    """One output folder per input file, named after its stem.

    Rows are rebalanced by stem: small files end in one task each, a large one is split over
    several writers, so neither tiny output files nor an oversized task arise.
    """
    stem = F.concat(F.lit("reformatted_"), F.regexp_replace("file_name", r"\.csv$", ""))
    named = monitors.withColumn("stem", stem).drop("file_name")
    write_table(named.hint("rebalance", F.col("stem")), path, ["stem"], fmt)


def write_named_files(monitors: DataFrame, path: str, order: Sequence[str] = ("Monitor Name",)) -> list[str]:
    """One CSV file per input file, `reformatted_<stem>.csv`, as in the folder that the inputs came from; returns the names.

    The rows of an input file are written by one task, in the given order, as one file is asked for. The job
    writes into a hidden folder beside the files, and only what it has committed is renamed, so retried or
    speculative tasks leave nothing behind; a file of the same name is replaced.
    """
    spark = monitors.sparkSession
    stem = F.coalesce(F.concat(F.lit("reformatted_"), F.regexp_replace("file_name", r"\.csv$", "")), F.lit("reformatted_"))
    named = monitors.withColumn("stem", stem).drop("file_name")
    hidden = f"{path.rstrip('/')}/_written-{uuid.uuid4().hex}"
    (named.repartition("stem").sortWithinPartitions("stem", *[F.col(f"`{c}`") for c in order]).write.partitionBy("stem")
     .option("header", True).option("nullValue", "NA").option("maxRecordsPerFile", 0).csv(hidden))
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = to_path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for part in files.globStatus(to_path(f"{hidden}/stem=*/part-*.csv")):
        name = unquote(part.getPath().getParent().getName().removeprefix("stem=")) + ".csv"
        final = to_path(target, name)
        files.delete(final, False)
        if not files.rename(part.getPath(), final):
            raise OSError(f"{name} could not be renamed")
        names.append(name)
    files.delete(to_path(hidden), True)
    return sorted(names)
