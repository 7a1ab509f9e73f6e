"""Intermediate tables that several later steps read."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the caller's own checkpoint folder, else the one spark.checkpoint.dir names.

    Without either it raises: a folder of one machine's own would lose the tables of the others.
    """
    context = spark.sparkContext
    named = (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
             or context.getConf().get("spark.checkpoint.dir"))
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
    return named


#: Folders written by staged() that remove_staged() has not deleted yet.
_written: list[str] = []


def remove_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this process; results that read them must have been used before."""
    context = spark.sparkContext
    while _written:
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession) -> str:
    """New path below the shared folder; remove_staged() deletes what was written there."""
    path = f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write once and read back.

    Used where a reduced table feeds several branches: the facts behind it are read once, a lost
    executor costs nothing that was written, and the optimizer knows the real size, so it
    broadcasts the table only when it is small.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, column: str, values: Iterable[int]) -> dict[int, DataFrame]:
    """Write once, a folder for each value of a column, and read each back: every one is known by its own size.

    A value without rows gives an empty table.
    """
    path, wanted = scratch_path(df.sparkSession), list(values)
    df.write.partitionBy(column).parquet(path)
    whole = df.sparkSession.read.schema(df.schema).parquet(path)
    found = {r[0] for r in whole.select(column).distinct().collect()}
    schema = df.drop(column).schema
    return {v: df.sparkSession.read.schema(schema).parquet(f"{path}/{column}={v}") if v in found
            else whole.filter(F.col(column) == v).drop(column) for v in wanted}
