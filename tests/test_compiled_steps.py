"""Steps that run once per pair, vertex or row: no loop where none is needed, no sort of all pairs."""

import math
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.catalog import responses, sources
from geoloom.functions import polyline
from geoloom.functions import rings as G
from geoloom.operators import spatial as S
from geoloom.sources import geojson

RINGS = f"place_id int, utm_zone int, outer {G.RING}, holes array<{G.RING}>"


def crosses(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / (ay - by + 1e-6) + bx:
            odd = not odd
    return len(ring) >= 3 and odd


def circle(x, y, r, n):
    return [(x + r * math.cos(6.283 * i / n), y + r * math.sin(6.283 * i / n)) for i in range(n)]


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]


def scene(spark, shapes):
    rnd = random.Random(3)
    pts = [(i, 32, rnd.uniform(-6000, 6000), rnd.uniform(-6000, 6000)) for i in range(400)]
    want = sorted((i, k) for i, _, x, y in pts for k, _, o, hs in shapes if crosses(x, y, o) and not any(crosses(x, y, h) for h in hs))
    return spark.createDataFrame(pts, "point_id int, utm_zone int, x double, y double"), spark.createDataFrame(shapes, RINGS), want


def test_small_polygons_are_tested_without_a_loop(spark, monkeypatch):
    monkeypatch.setattr(G, "point_in_polygon", lambda *a: F.raise_error(F.lit("loop")).cast("boolean"))
    shapes = [(k, 32, circle(k * 400.0, 0.0, 3000.0, 3 + k % 4), [square(k * 400.0, 0.0, 700.0)][: k % 2]) for k in range(9)]
    points, polygons, want = scene(spark, shapes)
    assert sorted(S.pairs_in_polygons(points, polygons, ["utm_zone"]).select("point_id", "place_id").collect()) == want


def test_large_and_odd_polygons_are_tested_as_well(spark):
    shapes = [(1, 32, circle(0.0, 0.0, 4000.0, 40), []), (2, 32, square(0.0, 0.0, 3000.0), [square(-900.0, 0.0, 500.0), square(900.0, 0.0, 500.0)]),
              (3, 32, square(0.0, 0.0, 3000.0), [circle(0.0, 0.0, 1500.0, 12)]), (4, 32, square(0.0, 0.0, 2000.0)[:2], []), (5, 32, square(500.0, 0.0, 2000.0), [square(500.0, 0.0, 900.0)[:2]])]
    points, polygons, want = scene(spark, shapes)
    assert sorted(S.pairs_in_polygons(points, polygons, ["utm_zone"]).select("point_id", "place_id").collect()) == want


def test_least_polygon_of_a_point_needs_no_sort_of_pairs(spark, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(S, "cut_lineage", cut)
    shapes = spark.createDataFrame([(k, 31, square(400000.0, 5500000.0, 3000.0 - 100 * (k // 2)), []) for k in (9, 4, 5, 2)], RINGS)
    none = spark.createDataFrame([], "place_id int, utm_zone int, x double, y double")
    points = spark.createDataFrame([(7, 49.645, 1.617)], "point_id int, lat double, lng double")
    assert [tuple(r) for r in S.locate_points(points, shapes, none).collect()] == [(7, 9, 0.0, True)]
    assert not any("SortAggregate(key=[point_id" in p for p in plans)
    tied = shapes.withColumn("outer", F.first("outer").over(W.partitionBy("utm_zone").orderBy("place_id")))
    assert [tuple(r) for r in S.locate_points(points, tied, none).collect()] == [(7, 2, 0.0, True)]


def test_rows_that_become_documents_are_dealt_over_tasks(spark, tmp_path):
    spark.range(1, 25_001).coalesce(1).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    docs = sources.geojson_docs(spark, str(tmp_path))
    sizes = docs.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 12_500
    assert docs.count() == 25_000


def test_rings_of_a_polygon_are_gathered_in_one_shuffle(spark):
    rows = [(k, square(6.0 + k / 100, 49.0, 0.02), [square(6.0 + k / 100, 49.0, 0.005)]) for k in range(3)]
    d = geojson.project_rings(spark.createDataFrame(rows, f"k int, outer {G.RING}, holes array<{G.RING}>"), ["k"])
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.k, len(r.outer), len(r.holes), r.utm_zone) for r in d.collect()) == [(0, 4, 1, 31), (1, 4, 1, 31), (2, 4, 1, 32)]


def test_steps_of_a_line_are_written_without_a_loop(spark):
    steps = [0, 1, -1, 15, 16, -17, 31, 32, 1023, -1024, 36_000_000, -36_000_000, (1 << 29) - 1, 1 << 29, -(1 << 40), (1 << 61), None]

    def text(v):
        z = -2 * v - 1 if v < 0 else 2 * v
        out = ""
        while z >= 32:
            out, z = out + chr(z % 32 + 95), z >> 5
        return out + chr(z + 63)

    d = spark.createDataFrame([(v,) for v in steps], "v bigint").withColumn("z", polyline.zigzag(F.col("v"))).withColumn("t", polyline.encode_step("z"))
    assert [r.t for r in d.collect()] == [None if v is None else text(v) for v in steps]
    assert "lambda" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_only_vertices_of_directions_are_shuffled(spark, small):
    plan = responses.direction_responses(spark, small)._jdf.queryExecution().executedPlan().toString()
    gathered = [line for line in plan.splitlines() if "ObjectHashAggregate" in line or "Exchange" in line]
    assert gathered and not any("html_instructions" in line or "turn " in line for line in gathered)
