"""Representatives on the sides of cells, tables of levels, pairs and rows that travel once, blocks that grow."""

import math
import random

from pyspark.sql import functions as F

from airtoll.operators import receptors as R
from airtoll.operators import spatial as G
from airtoll.plans import bindings as B
from airtoll.sources import ordered
from airtoll.sources.staging import staged, staged_by

SITES = "k string, x double, y double, first double"


def test_far_queries_are_bounded_by_the_side_that_faces_them(spark):
    r = random.Random(3)
    sites = staged(spark.createDataFrame([("a", r.random() * 40, r.random() * 20, 1.0) for _ in range(4000)], SITES))
    grid = G.plan_grid(sites, ["k"])
    cells = G._pyramid(sites, ["k"], grid).withColumns({"min_x": F.lit(10.0), "max_x": F.lit(11.0), "min_y": F.lit(900.0),
                                                       "max_y": F.lit(901.0), "x_scale": F.lit(1.0)}).filter("level = 0")
    reach = F.least(*[G.Plane.reach(x, y) for x, y in G.CORNERS])
    near = cells.agg(F.min(reach)).first()[0]
    alive = cells.filter(G.Plane.between("x0", "x1", "y0", "y1") <= near).count()
    assert alive < grid.count(0)[0]  # fewer than the row of cells that faces the query
    best = min(((x, y) for _, x, y, _ in sites.collect()), key=lambda p: max(0.0, 10 - p[0], p[0] - 11) ** 2 + (900 - p[1]) ** 2)
    shape = [[[(10.0, 900.0), (11.0, 900.0), (11.0, 901.0), (10.0, 901.0)]]]
    tracts = spark.createDataFrame([("t", [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in shape])],
                                   "GEOID string, polygons array<array<array<struct<x:double,y:double>>>>")
    found = G.nearest_receptor(G.tract_shapes(tracts, geographic=False), sites, ["k"], grid).collect()
    assert [(f["x"], f["y"]) for f in found] == [best]


def test_levels_are_tables_of_their_own(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "level int, v string")
    got = staged_by(df, "level", range(3))
    assert {k: sorted(r[0] for r in v.collect()) for k, v in got.items()} == {0: ["a", "b"], 1: [], 2: ["c"]}
    assert all(v.columns == ["v"] for v in got.values())
    assert staged_by(df.limit(0), "level", [0])[0].collect() == []


def test_shapes_of_a_small_file_are_made_by_all_tasks(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table in (B.tracts, B.outlines):
        assert table(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == parts


def test_blocks_follow_the_partitions_not_the_bytes(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}.csv").write_text("".join(f"line {j}\n" for j in range(2000)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = ordered.ordered_lines(spark, str(tmp_path), block_bytes=1024)
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    block = ordered.blocks_of(spark, str(tmp_path), 1024)
    assert size / block <= ordered.WAVES * parts and ordered.blocks_of(spark, str(tmp_path), 1 << 30) == 1 << 30
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    got = lines.groupBy("file_name").agg(F.max("number"), F.countDistinct("number"), F.max_by("line", "number")).collect()
    assert len(got) == 40 and {tuple(r)[1:] for r in got} == {(2000, 2000, "line 1999")}


def test_shapes_of_matches_are_made_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(G, "staged", lambda df: kept.append(df.columns) or staged(df))
    folder = "/root/testdata/sf0.001"
    G.points_in_tracts(B.outline_points(spark, folder), B.outlines(spark, folder))
    assert ["GEOID", "edges", "min_x", "max_x", "min_y", "max_y", "x_scale"] in kept


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_pairs_with_double_keys_are_dealt_once(spark):
    """Spark groups by normalised doubles: dealt by the doubles as they are, pairs went again, with the cells at the top."""
    sites = spark.range(500).selectExpr("cast(id % 20 as double) X", "cast(id as double) Y", "id / 1000 - 76D Longitude", "id % 7 + 39D Latitude")
    places = spark.range(300).selectExpr("concat('p', id) place", "id / 600 - 76D longitude", "id % 11 / 2 + 39D latitude")
    found = G.nearest_place(sites, places, ["X", "Y"])
    dealt = [line for line in exchanges(found) if "key_0" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]
    towns = [tuple(r) for r in places.select("longitude", "latitude", "place").collect()]
    best = {}
    for s in sites.collect():
        scale = math.cos(math.radians(s["Latitude"]))
        best[s["X"], s["Y"]] = min((round(math.hypot((x - s["Longitude"]) * scale, y - s["Latitude"]), 9), x, y, p) for x, y, p in towns)[-1]
    assert {(r["X"], r["Y"]): r["place"] for r in found.collect()} == best


def test_numbered_rows_travel_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(R, "staged", lambda df: kept.append((exchanges(df), staged(df))) or kept[-1][1])
    # two thirds of the rows are equal
    df = spark.range(9000).selectExpr("'a' file_name", "if(id < 6000, 1D, cast(id as double)) X", "cast(null as double) Y")
    numbered = R.number_rows(df, ["file_name"], ["Y", "X"], 1000)
    assert exchanges(numbered) == []
    (dealing, dealt), (_, starts) = kept
    assert len(dealing) == 1 and "rangepartitioning" in dealing[0]
    sizes = [r["count"] for r in dealt.groupBy("__range").count().collect()]
    assert max(sizes) < 3000 and starts.count() == len(sizes)
    got = numbered.orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(1, 9001))
    assert [r["X"] for r in got] == sorted(r["X"] for r in got)
