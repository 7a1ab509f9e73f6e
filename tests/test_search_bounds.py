"""Bounds of the nearest search: small enough to be compiled, tight where a side faces many sites, few edges measured."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry
from airtoll.operators import spatial as G
from airtoll.plans import bindings as B
from airtoll.sources.staging import staged

SITES = "k string, x double, y double, first double"
TRACTS = "GEOID string, polygons array<array<array<struct<x:double,y:double>>>>"


def shapes_of(spark, shapes, geographic=False):
    table = spark.createDataFrame([(k, [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts])
                                   for k, parts in shapes.items()], TRACTS)
    return staged(G.tract_shapes(table, geographic))


def candidates(monkeypatch):
    """Numbers of locations whose distance is measured, filled as searches run."""
    counts, made = [], G.Measure

    def counted(exact, metric):
        return made(lambda rows, row, carried: counts.append(rows.count()) or exact(rows, row, carried), metric)

    monkeypatch.setattr(G, "Measure", counted)
    return counts


@pytest.mark.parametrize("name", ["g6_outline_distance", "j2_nearest_receptor"])
def test_generated_methods_are_compiled(spark, monkeypatch, name):
    """The virtual machine leaves methods of more than 8,000 bytes of code to its interpreter."""
    sizes, write = [], DataFrameWriter.parquet
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")

    def record(df):
        sizes.extend(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode)))

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: record(self._df) or write(self, path, *a, **k))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages are planned as they run
    try:
        record(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(sizes) > 20 and max(sizes) < 8000


@pytest.mark.parametrize("far", [3.0, 700.0, 20000.0])
def test_sites_equally_far_from_a_side_are_not_all_kept(spark, monkeypatch, far):
    """A row of sites below a wide tract, and others below them: all of the row are as far, and the one with the lowest x is wanted."""
    r = random.Random(5)
    row = [("a", i / 100, 0.0, float(i)) for i in range(6000)]
    sites = staged(spark.createDataFrame(row + [("a", r.random() * 60, -0.001 * (1 + i % 500), -1.0) for i in range(6000)], SITES))
    shapes = shapes_of(spark, {"wide": [[[(10.005, far), (50.0, far), (50.0, far + 1), (10.005, far + 1)]]],
                               "left": [[[(-9.0, far), (-7.0, far), (-7.0, far + 1), (-9.0, far + 1)]]]})
    counts = candidates(monkeypatch)
    found = {f["GEOID"]: (f["x"], f["y"], f["distance"]) for f in G.nearest_receptor(shapes, sites, ["k"]).collect()}
    assert found["wide"] == (10.01, 0.0, far)
    assert found["left"] == (0.0, 0.0, round(math.hypot(7.0, far), 9))
    assert sum(counts) < 200  # of 4,000 sites that tie


@pytest.mark.parametrize("metric", [G.Plane, G.Sphere])
def test_edges_left_out_do_not_matter(spark, metric):
    """Combs, a square with a hole and two parts, with locations around, between the teeth, in the hole and inside."""
    def comb(x, y, teeth=12):
        top = [(x + i / teeth, y + (1.0 if i % 2 else 0.3)) for i in range(teeth + 1)]
        return [[[(x, y), (x + 1, y), *reversed(top)]]]

    def square(x, y, w):
        return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]

    shapes = {"comb": comb(0.0, 40.0), "pierced": [[square(2.0, 40.0, 1.0), square(2.3, 40.3, 0.4)]],
              "apart": [[square(4.0, 40.0, 0.3)], [square(4.7, 40.6, 0.3)]]}
    r = random.Random(11)
    points = [(f"{i}", r.uniform(-1, 6), r.uniform(38.5, 42.5), float(i)) for i in range(300)]
    table = shapes_of(spark, shapes, metric is G.Sphere)
    sites = staged(spark.createDataFrame(points, SITES))  # a scenario for each, so that every distance is returned
    got = {(f["GEOID"], f["k"]): f["distance"] for f in G.nearest_receptor(table, sites, ["k"], metric=metric).collect()}
    edges = table.select("GEOID", "x_scale", F.inline("edges")).crossJoin(F.broadcast(sites.select("k", "x", "y")))
    inside = G.encloses(F.col("x"), F.col("y"))
    whole = edges.groupBy("GEOID", "k").agg(F.round(F.when(inside, 0.0).otherwise(metric.to_outline(F.col("x"), F.col("y"))), metric.digits).alias("d"))
    wanted = {(w["GEOID"], w["k"]): w["d"] for w in whole.collect()}
    assert got == wanted and len(got) == 900 and 20 < sum(d == 0 for d in got.values()) < 500


def test_an_inner_corner_off_the_grid_is_a_bound_too(spark):
    """Triangles touch the sides of their boxes in corners only; brute force over sites near and far."""
    r = random.Random(23)
    triangles = {f"{i}": [[[(cx + r.uniform(-1, 1), cy + r.uniform(-1, 1)) for _ in range(3)]]]
                 for i in range(40) for cx, cy in [(r.uniform(-300, 300), r.uniform(-300, 300))]}
    points = [("a", r.uniform(-40, 40), r.uniform(-40, 40), 1.0) for _ in range(400)]
    shapes = shapes_of(spark, triangles)
    sites = staged(spark.createDataFrame(points, SITES))
    got = {f["GEOID"]: (f["distance"], f["x"], f["y"]) for f in G.nearest_receptor(shapes, sites, ["k"]).collect()}
    pairs = shapes.select("GEOID", "x_scale", F.inline("edges")).crossJoin(F.broadcast(sites.select("x", "y")))
    d = F.when(G.encloses(F.col("x"), F.col("y")), 0.0).otherwise(G.Plane.to_outline(F.col("x"), F.col("y")))
    best = pairs.groupBy("GEOID", "x", "y").agg(F.round(d, 9).alias("d")).groupBy("GEOID").agg(F.min(F.struct("d", "x", "y")).alias("b"))
    assert got == {b["GEOID"]: tuple(b["b"]) for b in best.collect()} and len(got) == 40


def test_shapes_are_not_unfolded_before_tracts_are_dealt(spark):
    """Spark moved the test for empty shapes, with the making of the edges, before the dealing: into the one task that reads the file."""
    shapes = G.tract_shapes(B.outlines(spark, "/root/testdata/sf0.001"))
    plan = shapes._jdf.queryExecution().optimizedPlan().toString()
    dealing = plan.index("Repartition")
    assert "size(" in plan[:dealing] and "size(" not in plan[dealing:] and shapes.count() > 100
