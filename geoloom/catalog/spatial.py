"""Spatial joins and ring measures over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import sql as S
from geoloom.catalog.tiles import AREA_SQL, areas
from geoloom.catalog.tracks import RV, vertices
from geoloom.functions import rings as G
from geoloom.operators import spatial as X
from geoloom.operators.ordered import with_previous
from geoloom.operators.utm import with_utm
from geoloom.functions.core import beside_one_row
from geoloom.registry import query
from geoloom.tables import table

# squares of p_size * 100 m around each part's point, in the zone of that point;
# every tenth place has a center only, every seventh polygon a hole
PLACES = f"""pa AS (SELECT p_partkey AS place_id, p_size, {P.SQL_REGION.format(k='p_partkey')} FROM part), {S.utm_ctes('pa', 'pu')},
pl AS (SELECT place_id, zone, ex AS cx, ny AS cy, p_size * 100e0 AS h, CASE WHEN place_id % 7 = 0 THEN p_size * 25e0 ELSE 0e0 END AS hh, place_id % 10 = 0 AS dot FROM pu)"""


def places(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("place_id"), "p_size", "p_partkey")
    p = with_utm(P.with_region(p, "p_partkey"))
    h = F.col("p_size") * 100.0
    hole = F.when(F.col("place_id") % 7 == 0, F.array(G.square_ring(F.col("x"), F.col("y"), F.col("p_size") * 25.0)))
    return p.select(
        "place_id", "utm_zone", "x", "y", "lat", "lng", "p_size",
        G.square_ring(F.col("x"), F.col("y"), h).alias("outer"),
        F.coalesce(hole, F.array().cast(f"array<{G.RING}>")).alias("holes"),
    )


def polygons(spark, d):
    return places(spark, d).filter("place_id % 10 <> 0").drop("x", "y", "lat", "lng")


def centers(spark, d):
    return places(spark, d).filter("place_id % 10 = 0").select("place_id", "utm_zone", "x", "y")


ORD = P.sql_points("orders", "o_orderkey * 37", "region", "o_orderkey AS point_id")
BOTH = f"""p0 AS ({ORD}), {S.utm_ctes('p0', 'p31', '31')}, {S.utm_ctes('p0', 'p32', '32')},
pz AS (SELECT point_id, zone, ex, ny FROM p31 UNION ALL SELECT point_id, zone, ex, ny FROM p32)"""
INSIDE = "ex >= cx - {h} AND ex < cx + {h} AND ny >= cy - {h} AND ny < cy + {h}"


def order_points(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"))
    o = o.withColumn("__k", F.col("point_id") * 37)
    return P.with_region(o, "__k").drop("__k")


@query(
    "point_in_polygon",
    f"""WITH {PLACES}, {BOTH} SELECT point_id, place_id FROM pz JOIN pl ON pz.zone = pl.zone AND NOT dot AND {INSIDE.format(h='h')} WHERE NOT ({INSIDE.format(h='hh')})""",
)
def point_in_polygon(spark, d):
    pts = X.with_nearby_zones(order_points(spark, d)).select("point_id", "utm_zone", "x", "y")
    return X.pairs_in_polygons(pts, polygons(spark, d), ["utm_zone"]).select("point_id", "place_id")


@query(
    "locate_points",
    f"""WITH {PLACES}, {BOTH},
i AS (SELECT point_id, arg_min(place_id, (4 * h * h - 4 * hh * hh, place_id)) AS place_id FROM pz JOIN pl ON pz.zone = pl.zone AND NOT dot AND {INSIDE.format(h='h')} WHERE NOT ({INSIDE.format(h='hh')}) GROUP BY 1),
r AS (SELECT * FROM pz WHERE point_id NOT IN (SELECT point_id FROM i)),
d AS (SELECT point_id, place_id, CASE WHEN dot THEN sqrt(pow(ex - cx, 2) + pow(ny - cy, 2))
  WHEN hh > 0 AND abs(ex - cx) <= hh AND abs(ny - cy) <= hh THEN least(hh - greatest(abs(ex - cx), abs(ny - cy)), 1e18)
  ELSE sqrt(pow(greatest(abs(ex - cx) - h, 0), 2) + pow(greatest(abs(ny - cy) - h, 0), 2)) END AS m FROM r JOIN pl ON r.zone = pl.zone),
n AS (SELECT point_id, arg_min(place_id, (m, place_id)) AS place_id, min(m) AS m FROM d GROUP BY 1)
SELECT point_id, place_id, 0e0 AS metres, TRUE AS inside FROM i UNION ALL SELECT point_id, place_id, round(m, 2), FALSE FROM n""",
)
def locate_points(spark, d):
    found = X.locate_points(order_points(spark, d), polygons(spark, d), centers(spark, d))
    return found.select("point_id", "place_id", F.round("distance_m", 2).alias("metres"), "inside")


@query(
    "nearest_settlement",
    f"""WITH {PLACES}, {BOTH}, d AS (SELECT point_id, place_id, sqrt(pow(ex - cx, 2) + pow(ny - cy, 2)) AS m FROM pz JOIN pl ON pz.zone = pl.zone)
SELECT point_id, arg_min(place_id, (m, place_id)) AS place_id, round(min(m), 2) AS metres FROM d WHERE m <= 900 GROUP BY 1""",
)
def nearest_settlement(spark, d):
    pts = X.with_nearby_zones(order_points(spark, d)).select("point_id", "utm_zone", "x", "y")
    c = places(spark, d).select("place_id", "utm_zone", "x", "y")
    n = X.nearest_places(pts, c, 900.0, on=["utm_zone"])
    return n.select("point_id", "place_id", F.round("distance_m", 2).alias("metres"))


@query("bounds_points", f"WITH a AS ({AREA_SQL}), p AS ({ORD}) SELECT n_nationkey, point_id FROM p JOIN a ON lat BETWEEN r_bottom AND r_top AND lng BETWEEN r_left AND r_right")
def bounds_points(spark, d):
    return X.points_in_areas(order_points(spark, d), areas(spark, d), "n_nationkey").select("n_nationkey", "point_id")


def route_legs(spark, d):
    """Legs of the line item routes in zone 32 metres."""
    v = with_utm(vertices(spark, d), 32).select("route_id", "seq", "x", "y")
    p = with_previous(v, ["route_id"], ["seq"], ["x", "y"], "p", F.floor(F.col("seq") / 10000000000000))
    p = p.filter(F.col("px").isNotNull())
    return p.select("route_id", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))


@query(
    "distance_to_routes",
    f"""WITH p0 AS ({P.sql_points('supplier', 's_suppkey * 37', 'region', 's_suppkey AS point_id')}), {S.utm_ctes('p0', 'pz', '32')}, v0 AS ({RV}), {S.utm_ctes('v0', 'v', '32')},
w AS (SELECT route_id, lag(ex) OVER o AS ax, lag(ny) OVER o AS ay, ex AS bx, ny AS by_ FROM v WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
l AS (SELECT * FROM w WHERE ax IS NOT NULL),
d AS (SELECT point_id, route_id, pz.ex - ax AS ux, pz.ny - ay AS uy, bx - ax AS dx, by_ - ay AS dy FROM pz, l),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy <= 1e-4 THEN 0e0 ELSE least(greatest((ux * dx + uy * dy) / (dx * dx + dy * dy), 0e0), 1e0) END AS f FROM d)
SELECT point_id, round(min(sqrt(pow(ux - f * dx, 2) + pow(uy - f * dy, 2))), 2) AS metres FROM t GROUP BY 1""",
)
def distance_to_routes(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id")).withColumn("__k", F.col("point_id") * 37)
    pts = with_utm(P.with_region(s, "__k"), 32).select("point_id", "x", "y")
    n = X.distance_to_routes(pts, route_legs(spark, d), "point_id", "route_id")
    return n.select("point_id", F.round("distance_m", 2).alias("metres"))


# ---- ring measures ----


@query("ring_area", "SELECT p_partkey AS place_id, round(4 * pow(p_size * 100e0, 2), 3) AS area FROM part")
def ring_area(spark, d):
    return places(spark, d).select("place_id", F.round(G.ring_area("outer"), 3).alias("area"))


NET = "4 * pow(p_size * 100e0, 2) - CASE WHEN p_partkey % 7 = 0 THEN 4 * pow(p_size * 25e0, 2) ELSE 0 END"


@query("net_area", f"SELECT p_partkey AS place_id, round({NET}, 3) AS area FROM part")
def net_area(spark, d):
    return places(spark, d).select("place_id", F.round(G.net_area("outer", "holes"), 3).alias("area"))


@query("total_area_km2", "SELECT p_size, round(sum(4 * pow(p_size * 100e0, 2)) / 1e6, 4) AS km2 FROM part GROUP BY 1")
def total_area_km2(spark, d):
    return places(spark, d).groupBy("p_size").agg(F.round(F.sum(G.ring_area("outer")) / 1e6, 4).alias("km2"))


@query("compactness", f"SELECT p_partkey AS place_id, round(({NET}) / (4 * pow(p_size * 100e0, 2)), 6) AS compactness FROM part")
def compactness(spark, d):
    return places(spark, d).select("place_id", F.round(G.compactness("outer", "holes"), 6).alias("compactness"))


@query("vertex_count", "SELECT p_partkey AS place_id, CASE WHEN p_partkey % 7 = 0 THEN 8 ELSE 4 END AS vertices FROM part")
def vertex_count(spark, d):
    holes = F.aggregate("holes", F.lit(0), lambda acc, h: acc + F.size(h))
    return places(spark, d).select("place_id", (F.size("outer") + holes).alias("vertices"))


@query("vertex_mean", f"WITH {PLACES} SELECT p_size, round(avg(cx), 2) AS x, round(avg(cy), 2) AS y FROM pl JOIN part ON p_partkey = place_id GROUP BY 1")
def vertex_mean(spark, d):
    v = places(spark, d).select("p_size", F.explode("outer").alias("v"))
    return v.groupBy("p_size").agg(F.round(F.avg("v.x"), 2).alias("x"), F.round(F.avg("v.y"), 2).alias("y"))


@query(
    "boundary_distance",
    f"""WITH {PLACES}, o AS (SELECT o_orderkey, 1 + o_custkey % (SELECT max(p_partkey) FROM part) AS k, CAST(o_orderkey % 9000 - 4500 AS DOUBLE) AS dx, CAST(o_custkey % 7000 - 3500 AS DOUBLE) AS dy FROM orders),
j AS (SELECT o_orderkey, abs(dx) AS ax, abs(dy) AS ay, h, hh FROM o JOIN pl ON place_id = k),
m AS (SELECT o_orderkey, CASE WHEN ax <= h AND ay <= h THEN h - greatest(ax, ay) ELSE sqrt(pow(greatest(ax - h, 0), 2) + pow(greatest(ay - h, 0), 2)) END AS a,
 CASE WHEN hh > 0 THEN CASE WHEN ax <= hh AND ay <= hh THEN hh - greatest(ax, ay) ELSE sqrt(pow(greatest(ax - hh, 0), 2) + pow(greatest(ay - hh, 0), 2)) END END AS b FROM j)
SELECT o_orderkey, round(least(a, coalesce(b, a)), 2) AS metres FROM m""",
)
def boundary_distance(spark, d):
    p = places(spark, d)
    top = table(spark, d, "part").agg(F.max("p_partkey").alias("n"))
    o = beside_one_row(table(spark, d, "orders").select("o_orderkey", "o_custkey"), top)
    o = o.withColumn("place_id", F.col("o_custkey") % F.col("n") + 1)
    j = o.join(p, "place_id").withColumns(
        {"px": F.col("x") + F.col("o_orderkey") % 9000 - 4500, "py": F.col("y") + F.col("o_custkey") % 7000 - 3500}
    )
    return j.select("o_orderkey", F.round(G.boundary_distance("px", "py", "outer", "holes"), 2).alias("metres"))


@query(
    "leg_corners",
    f"WITH v AS ({RV}), n AS (SELECT route_id, seq, coalesce(lead(lat) OVER o, first_value(lat) OVER o) AS next_lat, coalesce(lead(lng) OVER o, first_value(lng) OVER o) AS next_lng FROM v WINDOW o AS (PARTITION BY route_id ORDER BY seq)) SELECT * FROM n",
)
def leg_corners(spark, d):
    from geoloom.operators.ring_tables import leg_corners as corners

    n = corners(vertices(spark, d), "route_id", "seq", ["lat", "lng"], F.floor(F.col("seq") / 10000000000000))
    return n.select("route_id", "seq", "next_lat", "next_lng")


@query(
    "segments_intersect",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 50 AS DOUBLE) AS ax, CAST(l_suppkey % 50 AS DOUBLE) AS ay, CAST(l_orderkey % 50 AS DOUBLE) AS bx, CAST((l_partkey + l_suppkey) % 50 AS DOUBLE) AS bey,
 CAST(l_orderkey % 37 AS DOUBLE) AS cx, CAST(l_partkey % 41 AS DOUBLE) AS cy, CAST(l_suppkey % 43 AS DOUBLE) AS dx, CAST((l_orderkey + l_partkey) % 47 AS DOUBLE) AS dy FROM lineitem),
o AS (SELECT *, (bx - ax) * (cy - ay) - (bey - ay) * (cx - ax) AS k1, (bx - ax) * (dy - ay) - (bey - ay) * (dx - ax) AS k2, (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS k3, (dx - cx) * (bey - cy) - (dy - cy) * (bx - cx) AS k4 FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (k1 * k2 < 0 AND k3 * k4 < 0)
 OR (k1 = 0 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, bey) AND greatest(ay, bey))
 OR (k2 = 0 AND dx BETWEEN least(ax, bx) AND greatest(ax, bx) AND dy BETWEEN least(ay, bey) AND greatest(ay, bey))
 OR (k3 = 0 AND ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, dy) AND greatest(cy, dy))
 OR (k4 = 0 AND bx BETWEEN least(cx, dx) AND greatest(cx, dx) AND bey BETWEEN least(cy, dy) AND greatest(cy, dy)) AS crosses FROM o""",
)
def segments_intersect(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")

    def edge(*v):
        return F.struct(*[c.cast("double").alias(n) for c, n in zip(v, ("ax", "ay", "bx", "by"))])

    li = li.withColumns({"a": edge(p % 50, s % 50, o % 50, (p + s) % 50), "b": edge(o % 37, p % 41, s % 43, (o + p) % 47)})
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.segments_intersect(F.col("a"), F.col("b")).alias("crosses")
    )
