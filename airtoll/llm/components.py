"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtoll.sources.staging import staged


def _pointed(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    # Large: every node sees its larger neighbours and the smallest of all, itself included.
    least = (edges.groupBy("u").agg(F.min("v").alias("m"))
             .unionByName(edges.groupBy("v").agg(F.min("v").alias("m")).withColumnRenamed("v", "u"))
             .groupBy("u").agg(F.min("m").alias("m")))
    return (edges.join(least.withColumnRenamed("u", "at"), F.col("v") == F.col("at"))
            .select("u", F.col("m").alias("v")).distinct())


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): component is the smallest node reachable.

    Rounds go on until every edge points at the smallest node of its component; each round is a
    staged table, so lost executors cost one round at most. More than most_rounds rounds (their
    number grows with the logarithm of the longest path) raise an error instead of a wrong result.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        # Stars: no node points at two, and none that is pointed at points on.
        twice = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not twice and not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = staged(_pointed(staged(_pointed(now, small=False)), small=True))
    raise RuntimeError("components did not settle")
