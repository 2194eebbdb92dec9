"""Hot keys, split windows and partition independence."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.functions import rings as G
from geoloom.operators import proximity as X
from geoloom.operators import quality as Q
from geoloom.operators import routes as R
from geoloom.operators import shape_tiles as T
from geoloom.operators import spatial as S
from geoloom.operators.ordered import with_last_known, with_previous
from geoloom.operators.skew import hot_keys, skew_join
from geoloom.operators.utm import with_utm


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_skew_join_equals_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b"))
    assert hot_keys(left, ["k"], 200).count() == 1
    assert same(skew_join(left, right, ["k"], rows_per_task=200), left.join(right, "k"))
    none = right.filter("k > 5")
    assert same(skew_join(left, none, ["k"], "left", 200), left.join(none, "k", "left"))


def test_hot_rows_are_spread(spark):
    left = spark.range(4000).select(F.lit(7).alias("k"), F.col("id").alias("a"))
    hot = hot_keys(left, ["k"], 100).collect()
    assert hot[0]["__parts"] == 40


def test_split_windows_equal_whole_windows(spark, small):
    ev = P.event_points(spark, small).withColumn("g", F.col("user_id") % 2)
    order, cols = ["ts", "event_id"], ["lat", "lng"]
    whole = with_previous(ev, ["g"], order, cols).select("event_id", "prev_lat", "prev_lng")
    for unit in ("hour", "day", "month"):
        part = with_previous(ev, ["g"], order, cols, bucket=F.date_trunc(unit, "ts")).select("event_id", "prev_lat", "prev_lng")
        assert same(whole, part)
    value = F.when(F.col("event_type") == "signup", F.col("ts"))
    a = with_last_known(ev, ["g"], order, value, "v").select("event_id", "v")
    b = with_last_known(ev, ["g"], order, value, "v", bucket=F.date_trunc("day", "ts")).select("event_id", "v")
    assert same(a, b)


def test_partitions_do_not_matter(spark, small):
    ev = P.event_points(spark, small)
    one = R.leg_metrics(ev.coalesce(1), "user_id", ["ts", "event_id"])
    many = R.leg_metrics(ev.orderBy(F.col("event_id").desc()).repartition(13), "user_id", ["ts", "event_id"])
    assert same(one.select("event_id", "leg_km"), many.select("event_id", "leg_km"))


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(0, 9e4), rnd.uniform(0, 9e4)) for i in range(80)]
    segs = [(i, *(rnd.uniform(0, 9e4) for _ in range(4))) for i in range(25)]

    def dist(p, s):
        _, px, py = p
        _, ax, ay, bx, by = s
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    p = spark.createDataFrame(pts, "point_id bigint, x double, y double")
    s = spark.createDataFrame(segs, "sid bigint, ax double, ay double, bx double, by double")
    got = {r.point_id: (r.sid, r.distance_m) for r in S.nearest_segments(p, s, "point_id", ["sid"]).collect()}
    for q in pts:
        best = min((dist(q, x), x[0]) for x in segs)
        assert got[q[0]][0] == best[1] and abs(got[q[0]][1] - best[0]) < 1e-6
    near = S.nearest_segments(p, s, "point_id", ["sid"], max_distance=3000.0).collect()
    assert {r.point_id for r in near} == {q[0] for q in pts if min(dist(q, x) for x in segs) <= 3000.0}


@pytest.mark.parametrize(
    "places, point, want",
    [
        ([(1, 48.0, 7.0), (2, 48.0, 20.9)], (48.0, 60.0), 2),
        ([(1, 48.0, 7.0), (2, 48.0, 18.1)], (48.0, 14.9), 2),
        ([(1, 10.0, -179.9), (2, 10.0, 179.0)], (10.0, 179.9), 1),
    ],
)
def test_nearest_place_in_any_zone(spark, places, point, want):
    from geoloom.operators.utm import with_utm

    centers = with_utm(spark.createDataFrame(places, "place_id bigint, lat double, lng double")).select("place_id", "utm_zone", "x", "y")
    none = centers.limit(0).select("place_id", "utm_zone", F.array().cast("array<struct<x:double,y:double>>").alias("outer"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"))
    got = S.locate_points(spark.createDataFrame([(5, *point)], "point_id bigint, lat double, lng double"), none, centers).collect()
    assert [(r.point_id, r.place_id, r.inside) for r in got] == [(5, want, False)]


@pytest.mark.parametrize("limit", [None, 40.0])
def test_long_segments_are_searched_without_all_their_cells(spark, monkeypatch, limit):
    rnd = random.Random(3)
    spans = [(rnd.uniform(0, 9e4), rnd.uniform(0, 9e4), 10 ** rnd.uniform(4 * (i % 5 > 0), 5), rnd.uniform(0, 6.3)) for i in range(900)]
    segs = [(i, i % 2, x, y, x + m * math.cos(t), y + m * math.sin(t)) for i, (x, y, m, t) in enumerate(spans)]
    segs += [(900, 0, *segs[0][2:]), (901, 1, 5.0, 5.0, 5.0, 5.0), (902, 0, 7.0, 0.0, 7.0, 9e4), (903, 1, 0.0, 7.0, 9e4, 7.0)]
    spots = [(i, z, rnd.uniform(-2e4, 9e4), rnd.uniform(0, 9e4)) for i in range(120) for z in {0, i % 2}]
    spots += [(200, 0, segs[0][2], segs[0][3]), (201, 0, segs[0][2], segs[0][3]), (202, 1, 6e5, -3e5), (203, 0, 8e4, math.inf), (204, 7, 1.0, 1.0)]
    p = spark.createDataFrame(spots, "point_id long, zone int, x double, y double")
    s = spark.createDataFrame(segs, "sid long, zone int, ax double, ay double, bx double, by double")

    def metres(p, s):
        (px, py), (ax, ay, bx, by) = p[2:], s[2:]
        dx, dy = bx - ax, by - ay
        t = min(max(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) if dx * dx + dy * dy > 1e-4 else 0
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    want: dict = {}
    for q in spots:
        for t in segs:
            if q[1] == t[1] and math.isfinite(q[3]) and (limit is None or metres(q, t) <= limit):
                want[q[0]] = min(want.get(q[0], (math.inf, 0)), (round(metres(q, t), 6), t[0]))
    monkeypatch.setattr(S, "MAX_DISC_ROWS", 50)  # several broadcasts
    covers = []
    cells = S.with_segment_cells
    monkeypatch.setattr(S, "with_segment_cells", lambda df, *a: covers.append(df.count()) or cells(df, *a))
    got = S.nearest_segments(p, s, "point_id", ["sid"], ["zone"], max_distance=limit, cover_rows=0).collect()
    assert {r.point_id: (round(r.distance_m, 6), r.sid) for r in got} == want
    assert covers[-1] == 903 and covers[0] < 200  # all distinct segments, after a few


def test_polygons_of_all_sizes(spark):
    from geoloom.functions import rings as G

    rnd = random.Random(9)
    polys = [(i, rnd.uniform(-5e4, 5e4), rnd.uniform(-5e4, 5e4), 10 ** rnd.uniform(1, 5)) for i in range(60)]
    pts = [(i, rnd.uniform(-6e4, 6e4), rnd.uniform(-6e4, 6e4)) for i in range(300)]
    pd = spark.createDataFrame(polys, "place bigint, cx double, cy double, h double").select(
        "place", G.square_ring(F.col("cx"), F.col("cy"), F.col("h")).alias("outer"), F.array().cast(f"array<{G.RING}>").alias("holes")
    )
    got = sorted((r.point_id, r.place) for r in S.pairs_in_polygons(spark.createDataFrame(pts, "point_id bigint, x double, y double"), pd).collect())
    want = sorted((p[0], q[0]) for p in pts for q in polys if abs(p[1] - q[1]) < q[3] and abs(p[2] - q[2]) < q[3])
    assert got == want


def test_box_pairs_once_each(spark):
    from geoloom.operators.areas import box_pairs

    rnd = random.Random(4)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, w, h = rnd.uniform(-10, 10), rnd.uniform(-10, 10), 10 ** rnd.uniform(-3, 1), 10 ** rnd.uniform(-3, 1)
            out.append((i, x, y, x + w, y + h))
        return out

    a, b = boxes(80), boxes(70)
    da = spark.createDataFrame(a, "i bigint, a0 double, a1 double, a2 double, a3 double")
    db = spark.createDataFrame(b, "j bigint, b0 double, b1 double, b2 double, b3 double")
    got = sorted((r.i, r.j) for r in box_pairs(da, db, ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3"), 0.05).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert got == want


def test_connected_groups_on_a_long_chain(spark):
    n = spark.range(40)
    e = spark.range(39).filter("id <> 19").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.group_id for r in X.connected_groups(n, e).collect()}
    assert all(got[i] == (0 if i < 20 else 20) for i in range(40))


def test_eviction_in_one_moment(spark):
    """Most tiles have one time and the cap falls among them: ids divide them further; sizes of nothing and no time."""
    from geoloom.operators.tile_store import evict_oldest

    rows = [(i, None if i % 97 == 0 else "2024-01-05" if i % 5 else f"2024-0{1 + i % 3}-0{1 + i % 7}", 0 if i % 31 == 0 else i % 13) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, day string, bytes bigint").withColumn("cached_at", F.to_timestamp("day"))
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]), reverse=True)
    for cap in (0, 1, 5000, 9001, 10**9):
        run, want = 0, []
        for r in ordered:
            run += r[2]
            if run <= cap:
                want.append(r[0])
        for finer in ([], [F.date_trunc("day", "cached_at"), F.floor(F.col("id") / 64), F.col("id")]):
            got = evict_oldest(df, cap, bucket=F.date_trunc("month", "cached_at"), finer=finer)
            assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(want)


def wheel(rnd, n, cx, cy, r):
    """A ring of n corners around a point, in turn at most half as far, so that it never meets itself."""
    return [(cx + math.cos(2 * math.pi * i / n) * r * rnd.uniform(0.5, 1), cy + math.sin(2 * math.pi * i / n) * r * rnd.uniform(0.5, 1)) for i in range(n)]


def in_ring(x, y, ring, slack=1e-6):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / (ay - by + slack) + bx:
            odd = not odd
    return odd


def as_ring(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def test_small_rings_need_no_grid(spark, monkeypatch):
    """Their edges are compared in place, with what the grid gives; several rings of a polygon meet on the grid."""
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        ring = [(rnd.uniform(0, 90), rnd.uniform(0, 90)) for _ in range(rnd.randint(3, 8))] if i % 2 else wheel(rnd, 12, 50, 50, 40)
        rows.append((i if i else None, 0, as_ring(ring)))
    one = spark.createDataFrame(rows, "poly_id int, ring_no int, ring array<struct<x:double,y:double>>")
    several = one.unionByName(one.selectExpr("(poly_id + 1) % 60 AS poly_id", "1 AS ring_no", "ring"))
    grid = Q._crossings_on_grid
    want = [sorted(map(tuple, grid(df.filter("size(ring) >= 3")).distinct().collect())) for df in (one, several)]
    assert sorted(map(tuple, Q.edge_crossings(several).collect())) == want[1] and len(want[1]) > len(want[0]) > 0
    monkeypatch.setattr(Q, "SMALL_RING", 4)
    assert sorted(map(tuple, Q.edge_crossings(one).collect())) == want[0]
    monkeypatch.setattr(Q, "SMALL_RING", 64)
    monkeypatch.setattr(Q, "_crossings_on_grid", None)
    assert sorted(map(tuple, Q.edge_crossings(one).collect())) == want[0]


def shapes_and_spots(rnd):
    """Polygons of many sizes with holes, level edges, crossings and corners on spots; spots crowd in places."""
    shapes = []
    for i in range(70):
        x, y, r = rnd.uniform(-9000, 9000), rnd.uniform(-9000, 9000), 10 ** rnd.uniform(1, 4)
        outer = wheel(rnd, rnd.randint(3, 9), x, y, r) if i % 3 else [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
        holes = [wheel(rnd, 5, x, y, r / 2)] if i % 4 == 0 else []
        shapes.append((i, [outer, *holes]))
    shapes.append((70, [[(0, 0), (4000, 4000), (4000, 0), (0, 4000)]]))
    spots = [(rnd.gauss(0, 3000), rnd.gauss(0, 3000)) if i % 2 else (rnd.uniform(-20000, 20000), rnd.uniform(-20000, 20000)) for i in range(3000)]
    spots += [v for _, rings in shapes for v in rings[0]] + [(4000.0, 2000.0), (8000.0, 8000.0), (-2000.0, 0.0)]
    return shapes, spots


def test_counts_in_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "POINTS_AT_ONCE", 200)
    monkeypatch.setattr(T, "SHAPES_AT_ONCE", 5)
    monkeypatch.setattr(T, "ROWS_IN_GROUP", 2000)
    shapes, spots = shapes_and_spots(random.Random(8))
    p = spark.createDataFrame([(31, i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "utm_zone int, point_ref bigint, x double, y double")
    # the last shape is two polygons
    nested = [(31, i, [[as_ring(r) for r in rings]]) for i, rings in shapes] + [(31, 99, [[as_ring(r) for r in rings] for _, rings in shapes[:2]]), (32, 98, [[as_ring(shapes[0][1][0])]])]
    s = T.with_box(spark.createDataFrame(nested, "utm_zone int, shape_ref bigint, polygons array<array<array<struct<x:double,y:double>>>>"))
    inside = {i: {k for k, (x, y) in enumerate(spots) if in_ring(x, y, rings[0]) and not any(in_ring(x, y, h) for h in rings[1:])} for i, rings in shapes}
    inside[99] = inside[0] | inside[1]
    got = T.in_tiles(p, s, T.counted, "shape_ref bigint, n bigint").groupBy("shape_ref").agg(F.sum("n").alias("n")).filter("n > 0")
    assert {r.shape_ref: r.n for r in got.collect()} == {i: len(k) for i, k in inside.items() if k}
    least = T.in_tiles(p, s, T.least_shape, "point_ref bigint, shape_ref bigint").groupBy("point_ref").agg(F.min("shape_ref").alias("s"))
    want = {k: min(i for i, held in inside.items() if k in held) for k in set().union(*inside.values())}
    assert {r.point_ref: r.s for r in least.collect()} == want


def test_other_places_are_counted_without_pairs(spark, monkeypatch):
    """No row for each center within a polygon, unless its instance has several centers or the group lies in two zones."""
    centers = [(i, 49.0 + i % 40 / 200, 5.5 + i // 40 / 200) for i in range(1600)]
    c = spark.createDataFrame(centers, "place_id int, lat double, lng double")
    inst = c.selectExpr("place_id", "CASE WHEN place_id % 100 = 7 THEN 7 ELSE place_id END AS group_id")
    at = with_utm(c, 31)
    h = 3000.0
    polys = at.filter("place_id % 9 = 0").select(
        "place_id", F.lit("p").alias("provider_key"), F.col("place_id").cast("string").alias("external_key"), F.lit(31).alias("utm_zone"),
        G.square_ring(F.col("x"), F.col("y"), F.lit(h)).alias("outer"), F.array().cast(f"array<{G.RING}>").alias("holes"),
    )
    spots = {r.place_id: (r.x, r.y) for r in at.collect()}
    group = {i: 7 if i % 100 == 7 else i for i in spots}
    want = {}
    for i in range(0, 1600, 9):
        x, y = spots[i]
        ring = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
        want[i] = len({group[k] for k, (a, b) in spots.items() if k != i and in_ring(a, b, ring)})
    asked = []
    pairs = Q.pairs_in_polygons
    monkeypatch.setattr(Q, "pairs_in_polygons", lambda pts, *rest: asked.append(pts) or pairs(pts, *rest))
    got = {r.place_id: r.others for r in Q.contained_other_places(polys, c, inst).collect()}
    assert got == {i: n for i, n in want.items() if n}
    assert [p.select("other_group").distinct().count() for p in asked] == [1]


def test_located_points_are_not_paired(spark, monkeypatch):
    """A point goes through the polygons from the least one on; only broken polygons and points without a name are paired."""
    rnd = random.Random(4)
    centers = [(i, 31, rnd.uniform(4.4e5, 4.8e5), rnd.uniform(5.43e6, 5.47e6), 10 ** rnd.uniform(2.5, 4)) for i in range(200)]
    polys = [(i, z, as_ring(wheel(rnd, 5, x, y, r)), [as_ring(wheel(rnd, 4, x, y, r / 3))] if i % 5 == 0 else []) for i, z, x, y, r in centers]
    polys.append((500, 31, [*as_ring([(4.5e5, 5.44e6), (4.6e5, 5.44e6)]), {"x": 4.6e5, "y": None}, {"x": 4.5e5, "y": 5.46e6}], []))
    s = spark.createDataFrame(polys, "place_id int, utm_zone int, outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    spots = spark.createDataFrame([(i, rnd.uniform(49.05, 49.35), rnd.uniform(2.2, 2.7)) for i in range(400)], "point_id int, lat double, lng double")
    none = s.filter("place_id < 0").selectExpr("place_id", "utm_zone", "0D AS x", "0D AS y")
    at = S.with_zones_in_use(spots, spark.createDataFrame([(31, 0.0, 0.0, 0.0, 0.0)], "__try_zone int, __zx0 double, __zy0 double, __zx1 double, __zy1 double"))
    pairs = S.pairs_in_polygons(at.select("point_id", "utm_zone", "x", "y"), s.withColumn("area", G.net_area("outer", "holes")), ["utm_zone"])
    want = {r.point_id: r.b.place_id for r in pairs.groupBy("point_id").agg(F.min(F.struct("area", "place_id")).alias("b")).collect()}
    asked = []
    plain = S.pairs_in_polygons
    monkeypatch.setattr(S, "pairs_in_polygons", lambda pts, shapes, *rest: asked.append((pts, shapes)) or plain(pts, shapes, *rest))
    found = S.locate_points(spots, s, none).collect()
    assert {r.point_id: r.place_id for r in found if r.inside} == want and len(found) == 400 and len(want) > 100
    assert [{r[0] for r in shapes.select("__place").collect()} for _, shapes in asked] == [{500}]
    texts = spots.withColumn("point_id", F.when(F.col("point_id") > 0, F.concat(F.lit("p"), "point_id")))
    assert {r.point_id: r.place_id for r in S.locate_points(texts, s, none).collect() if r.inside and r.point_id} == {f"p{i}": k for i, k in want.items() if i}
