"""Session settings for tests and the benchmark; jobs on a cluster bring their own session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, folder: str | None = None) -> SparkSession:
    """Session on this machine; staged tables go to `folder`, by default one below the system's temporary folder.

    One machine is all executors there are, so its own folder is shared.
    """
    folder = folder or tempfile.mkdtemp(prefix="airtoll-")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("airtoll")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )

