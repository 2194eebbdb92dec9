"""Tile arithmetic over the point views."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import sql as S
from geoloom.functions.grids import GRS80_MINOR, grid
from geoloom.operators import tiling as T
from geoloom.operators.transverse import AXIS
from geoloom.functions.core import beside_one_row
from geoloom.registry import query
from geoloom.tables import table

EV = P.sql_points("events", "event_id", extra="event_id, user_id, ts")
Z = 8


@query(
    "tile_histogram",
    f"""WITH p AS ({EV}), t AS (SELECT {S.merc_tile('lat', 'lng', Z)[0]} AS tile_x, {S.merc_tile('lat', 'lng', Z)[1]} AS tile_y FROM p)
SELECT tile_x, tile_y, count(*) AS n, {Z} AS zoom FROM t GROUP BY ALL""",
)
def tile_histogram(spark, d):
    return T.tile_histogram(P.event_points(spark, d), Z)


@query("with_tile", f"WITH p AS ({EV}) SELECT event_id, {S.merc_tile('lat', 'lng', 12)[0]} AS tile_x, {S.merc_tile('lat', 'lng', 12)[1]} AS tile_y FROM p")
def with_tile(spark, d):
    return T.with_tile(P.event_points(spark, d), 12).select("event_id", "tile_x", "tile_y")


@query(
    "tile_origin_pixel",
    f"WITH p AS ({EV}) SELECT event_id, {S.merc_tile('lat', 'lng', 10)[0]} * 256 AS origin_x, {S.merc_tile('lat', 'lng', 10)[1]} * 256 AS origin_y FROM p",
)
def tile_origin_pixel(spark, d):
    t = T.with_tile(P.event_points(spark, d), 10)
    ox, oy = T.tile_origin_pixel(F.col("tile_x"), F.col("tile_y"))
    return t.select("event_id", ox.alias("origin_x"), oy.alias("origin_y"))


# ---- one pair of queries per grid: degrees to pixel and back ----


def grid_points(spark, d, g) -> DataFrame:
    """Order keys spread over the grid's own area."""
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    return o.withColumns(
        {
            "lng": F.lit(g.min_lng) + (k * 7919 % 10000) / F.lit(1e4) * (g.max_lng - g.min_lng),
            "lat": F.lit(g.min_lat) + (k * 104729 % 10000) / F.lit(1e4) * (g.max_lat - g.min_lat),
        }
    )


def sql_grid_points(g) -> str:
    return (
        f"SELECT o_orderkey, {S.n(g.min_lng)} + ((o_orderkey*7919) % 10000)/1e4 * {S.n(g.max_lng - g.min_lng)} AS lng, "
        f"{S.n(g.min_lat)} + ((o_orderkey*104729) % 10000)/1e4 * {S.n(g.max_lat - g.min_lat)} AS lat FROM orders"
    )


def sql_pixel(g, z) -> str:
    src = sql_grid_points(g)
    if g.kind == "mercator":
        x, y = S.merc("lat", "lng", z)
        return f"WITH p AS ({src}) SELECT o_orderkey, {x} AS px, {y} AS py FROM p"
    if g.kind == "swiss":
        w, h = (256 * v for v in g.matrix[z])
        s = f"sin(lat * {S.PI} / 180)"
        return f"""WITH p AS ({src}) SELECT o_orderkey,
 CAST(floor(least(greatest((lng + 180) / 360 * {S.n(w)} + 0.5e0, 0e0), {S.n(w - 1)})) AS BIGINT) AS px,
 CAST(floor(least(greatest((0.5e0 - ln((1 + {s}) / (1 - {s})) / (4 * {S.PI})) * {S.n(h)} + 0.5e0, 0e0), {S.n(h - 1)})) AS BIGINT) AS py FROM p"""
    if g.kind == "ellipsoid":
        e = T.ELLIPSOID_E
        r = "radians(lat)"
        ratio = f"(tan({math.pi / 4} + {r} / 2) / pow(tan({math.pi / 4} + asin({S.n(e)} * sin({r})) / 2), {S.n(e)}))"
        z1 = f"{S.n(2.0 ** (23 - z))}"
        return f"""WITH p AS ({src}) SELECT o_orderkey,
 CAST(trunc(({S.n(T.ELLIPSOID_HALF)} + radians(lng) * 6378137e0) * {S.n(T.ELLIPSOID_SCALE)} / {z1}) AS BIGINT) AS px,
 CAST(trunc(({S.n(T.ELLIPSOID_HALF)} - ln({ratio}) * 6378137e0) * {S.n(T.ELLIPSOID_SCALE)} / {z1}) AS BIGINT) AS py FROM p"""
    if g.kind == "plate":
        step = f"(360e0 / {S.n(float(2 * g.tile << z))})"
        return f"WITH p AS ({src}) SELECT o_orderkey, CAST(trunc((lng + 180) / {step}) AS BIGINT) AS px, CAST(trunc((90 - lat) / {step}) AS BIGINT) AS py FROM p"
    if g.kind == "plate_table":
        r = S.n(g.resolutions[z])
        return f"WITH p AS ({src}) SELECT o_orderkey, CAST(floor((lng + 400) / {r}) AS BIGINT) AS px, CAST(floor((400 - lat) / {r}) AS BIGINT) AS py FROM p"
    if g.kind == "transverse":
        es = 1 - (GRS80_MINOR / AXIS) ** 2
        r = S.n(g.resolutions[z])
        return f"""WITH p AS ({src}), {S.datum_ctes('p', 'q')},
{S.tm_ctes('q', 'r', 'radians(sla)', f'(radians(lng) - {S.n(g.meridian)})', es, g.scale, f'{S.n(g.false_easting)}', f'({S.n(g.false_northing)})')}
SELECT o_orderkey, CAST(floor((gx - ({S.n(g.origin_x)})) / {r}) AS BIGINT) AS px, CAST(floor(({S.n(g.origin_y)} - gy) / {r}) AS BIGINT) AS py FROM r"""
    # wide UTM-33 strip: terms of the Redfearn series
    es, k = S.WGS84_ES, f"{S.n(T.SINGLE_SCALE)}"
    from geoloom.operators.transverse import arc_coefficients

    m0, m2, m4, m6 = arc_coefficients(es)
    return f"""WITH p AS ({src}),
a AS (SELECT *, radians(lat) AS f, radians(lng - 15) AS w, pow(tan(radians(lat)), 2) AS t, 1 - {S.n(es)} * pow(sin(radians(lat)), 2) AS q FROM p),
b AS (SELECT *, {S.n(AXIS)} / sqrt(q) AS nu, q / (1 - {S.n(es)}) AS s, pow(w * cos(f), 2) AS h,
  {S.n(AXIS)} * ({S.n(m0)} * f - {S.n(m2)} * sin(2 * f) + {S.n(m4)} * sin(4 * f) - {S.n(m6)} * sin(6 * f)) AS m FROM a),
c AS (SELECT *, 500000 + {k} * nu * w * cos(f) * (1 + h / 6 * (s - t)
   + h * h / 120 * (4 * s * s * s * (1 - 6 * t) + s * s * (1 + 8 * t) - 2 * s * t + t * t)
   + pow(h, 3) / 5040 * (61 - 479 * t + 179 * t * t - pow(t, 3))) AS e,
 {k} * (m + nu * sin(f) * cos(f) * w * w * (0.5e0 + h / 24 * (4 * s * s + s - t)
   + h * h / 720 * (8 * pow(s, 4) * (11 - 24 * t) - 28 * pow(s, 3) * (1 - 6 * t) + s * s * (1 - 32 * t) - 2 * s * t + t * t)
   + pow(h, 3) / 40320 * (1385 - 3111 * t + 543 * t * t - pow(t, 3)))) AS n FROM b)
SELECT o_orderkey, CAST((round_even(round(e, 2), 0) + 3700000) * 32 AS BIGINT) >> {20 - z} AS px,
 {256 << z} - (CAST((round_even(round(n, 2), 0) - 1300000) * 32 AS BIGINT) >> {20 - z}) AS py FROM c"""


GRID_ZOOM = {
    "mercator": 8, "ellipsoid_mercator": 9, "plate_carree": 7, "plate_carree_256": 7, "plate_carree_table": 6,
    "swiss": 22, "lks94": 6, "lks94_relief": 6, "lks92": 6, "sweref99": 8, "utm33": 8,
}


def _register_grid(name: str, z: int) -> None:
    g = grid(name)

    @query(f"pixel_{name}", sql_pixel(g, z))
    def to_pixel(spark, d):
        return T.with_pixel(grid_points(spark, d, g), z, name).select("o_orderkey", "px", "py")

    # back to degrees: the position differs from the source by less than a pixel
    @query(f"position_{name}", "SELECT o_orderkey, TRUE AS close FROM orders")
    def to_position(spark, d):
        # the UTM-33 series only inverts near its own strip
        p = grid_points(spark, d, g if g.kind != "utm33" else replace(g, min_lng=5.0, max_lng=25.0))
        p = T.with_pixel(p, z, name)
        p = T.with_position(p, z, name, lat="back_lat", lng="back_lng")
        p = T.with_pixel(p, z, name, "back_lat", "back_lng", "again_x", "again_y")
        slack = 2 if g.kind != "ellipsoid" else 3
        return p.select(
            "o_orderkey",
            ((F.abs(F.col("again_x") - F.col("px")) <= slack) & (F.abs(F.col("again_y") - F.col("py")) <= slack)).alias("close"),
        )


for _name, _z in GRID_ZOOM.items():
    _register_grid(_name, _z)


@query(
    "from_pixel_mercator",
    f"""SELECT o_orderkey, round({S.merc_lat('(o_orderkey*104729) % 65536', 8)}, 6) AS lat, round({S.merc_lng('(o_orderkey*7919) % 65536', 8)}, 6) AS lng FROM orders""",
)
def from_pixel_mercator(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    o = o.withColumns({"px": k * 7919 % 65536, "py": k * 104729 % 65536})
    return T.with_position(o, 8).select("o_orderkey", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    "ground_resolution",
    f"WITH p AS ({EV}) SELECT event_id, round(cos(radians(lat)) * 2 * {S.PI} * 6378137 / {256 << 12}, 6) AS metres FROM p",
)
def ground_resolution(spark, d):
    return P.event_points(spark, d).select("event_id", F.round(T.ground_resolution("lat", 12), 6).alias("metres"))


@query(
    "tile_matrix",
    """WITH n AS (SELECT count(*) AS events, max(event_id) AS k FROM events), z AS (SELECT CAST(range AS INTEGER) AS zoom FROM range(0, 20))
SELECT zoom, CAST(pow(2, zoom) AS BIGINT) AS size_x, CAST(pow(4, zoom) AS BIGINT) AS items, CAST(256 * pow(2, zoom) AS BIGINT) AS pixels_x, events / pow(4, zoom) AS per_tile FROM z, n""",
)
def tile_matrix(spark, d):
    n = table(spark, d, "events").agg(F.count(F.lit(1)).alias("events"))
    m = T.tile_matrix(spark, "mercator", 19)
    # one counted row against the twenty zoom rows
    return beside_one_row(m, n).select(
        "zoom", "size_x", "items", "pixels_x", (F.col("events") / F.col("items").cast("double")).alias("per_tile")
    )


# ---- areas ----

AREA_SQL = """SELECT n_nationkey, 49e0 + ((n_nationkey*104729) % 10000)/1e4 AS r_bottom, 5.5e0 + ((n_nationkey*7919) % 10000)/1e4 AS r_left,
 49e0 + ((n_nationkey*104729) % 10000)/1e4 + 0.1e0 + (n_nationkey % 5) * 0.07e0 AS r_top,
 5.5e0 + ((n_nationkey*7919) % 10000)/1e4 + 0.15e0 + (n_nationkey % 7) * 0.05e0 AS r_right FROM nation"""


def areas(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    lat, lng = P.region_lat(k), P.region_lng(k)
    return n.withColumns(
        {
            "r_top": lat + 0.1 + (k % 5) * F.lit(0.07),
            "r_left": lng,
            "r_bottom": lat,
            "r_right": lng + 0.15 + (k % 7) * F.lit(0.05),
        }
    )


@query(
    "tiles_for_area",
    f"""WITH a AS ({AREA_SQL}), t AS (SELECT n_nationkey,
 greatest(0, {S.merc_tile('r_top', 'r_left', 11)[0]} - 1) AS x0, {S.merc_tile('r_bottom', 'r_right', 11)[0]} + 1 AS x1,
 greatest(0, {S.merc_tile('r_top', 'r_left', 11)[1]} - 1) AS y0, {S.merc_tile('r_bottom', 'r_right', 11)[1]} + 1 AS y1 FROM a),
u AS (SELECT n_nationkey, unnest(range(x0, x1 + 1)) AS tile_x, y0, y1 FROM t)
SELECT n_nationkey, tile_x, unnest(range(y0, y1 + 1)) AS tile_y FROM u""",
)
def tiles_for_area(spark, d):
    return T.tiles_for_area(areas(spark, d), 11, padding=1).select("n_nationkey", "tile_x", "tile_y")


@query(
    "plan_tiles",
    f"""WITH c AS ({P.sql_points('customer', 'c_custkey', extra='c_custkey')}),
t AS (SELECT c_custkey, {S.merc_tile('lat', 'lng', 6)[0]} AS cx, {S.merc_tile('lat', 'lng', 6)[1]} AS cy, 1 + c_custkey % 3 AS w, 1 + c_custkey % 2 AS h FROM c),
o AS (SELECT *, unnest(range(CAST(floor(-w * 0.75e0) AS BIGINT) - 1, CAST(ceil(w * 0.75e0) AS BIGINT) + 2)) AS dx FROM t),
q AS (SELECT *, unnest(range(CAST(floor(-h * 0.75e0) AS BIGINT) - 1, CAST(ceil(h * 0.75e0) AS BIGINT) + 2)) AS dy FROM o)
SELECT c_custkey, cx + dx AS tile_x, cy + dy AS tile_y, (cx + dx) * 256 AS pixel_x, (cy + dy) * 256 AS pixel_y, dx * dx + dy * dy AS dist_sqr
FROM q WHERE cx + dx BETWEEN 0 AND 63 AND cy + dy BETWEEN 0 AND 63""",
)
def plan_tiles(spark, d):
    c = P.with_world(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    c = T.with_tile(c, 6, x="center_x", y="center_y")
    k = F.col("c_custkey")
    big = F.lit(63).cast("bigint")
    zero = F.lit(0).cast("bigint")
    c = c.withColumns(
        {"view_w": k % 3 + 1, "view_h": k % 2 + 1, "min_x": zero, "min_y": zero, "max_x": big, "max_y": big,
         "scale": F.lit(0.75), "margin": F.lit(1)}
    )
    return T.plan_tiles(c).select("c_custkey", "tile_x", "tile_y", "pixel_x", "pixel_y", "dist_sqr")


def _split_sql(step: float) -> str:
    return f"""WITH RECURSIVE a AS ({AREA_SQL}),
s AS (SELECT n_nationkey, r_top, r_left, r_right, r_bottom AS b FROM a
  UNION ALL SELECT n_nationkey, r_top, r_left, r_right, b + {S.n(step)} FROM s WHERE b + {S.n(step)} < r_top),
w AS (SELECT n_nationkey, r_top, r_right, b, r_left AS l FROM s
  UNION ALL SELECT n_nationkey, r_top, r_right, b, l + {S.n(step)} FROM w WHERE l + {S.n(step)} < r_right)
SELECT n_nationkey, round(b, 9) AS cell_bottom, round(l, 9) AS cell_left, round(least(b + {S.n(step)}, r_top), 9) AS cell_top,
 round(least(l + {S.n(step)}, r_right), 9) AS cell_right FROM w"""


def _split(spark, d, step):
    s = T.split_area_grid(areas(spark, d), step)
    return s.select("n_nationkey", *[F.round(c, 9).alias(c) for c in ("cell_bottom", "cell_left", "cell_top", "cell_right")])


@query("split_area_grid_places", _split_sql(0.20))
def split_area_grid_places(spark, d):
    return _split(spark, d, 0.20)


@query("split_area_grid_residential", _split_sql(0.10))
def split_area_grid_residential(spark, d):
    return _split(spark, d, 0.10)


TILED = f"""WITH p AS ({EV}), t AS (SELECT event_id, CAST(event_id % 16 AS INTEGER) AS zoom, lat, lng FROM p),
u AS (SELECT event_id, zoom, {S.merc_tile('lat', 'lng', 'zoom')[0]} AS x, {S.merc_tile('lat', 'lng', 'zoom')[1]} AS y FROM t)"""


def _tiled(spark, d) -> DataFrame:
    p = P.event_points(spark, d).withColumn("zoom", (F.col("event_id") % 16).cast("int"))
    return T.with_tile(p, "zoom", x="x", y="y").select("event_id", "zoom", "x", "y")


@query(
    "with_quadkey",
    TILED + """ SELECT event_id, CASE WHEN zoom = 0 THEN '' ELSE list_aggregate(list_transform(range(1, zoom + 1),
 lambda i: CAST(((x >> CAST(zoom - i AS BIGINT)) & 1) + 2 * ((y >> CAST(zoom - i AS BIGINT)) & 1) AS VARCHAR)), 'string_agg', '') END AS quadkey FROM u""",
)
def with_quadkey(spark, d):
    return _tiled(spark, d).select("event_id", T.quadkey("x", "y", "zoom").alias("quadkey"))


@query("from_quadkey", TILED + " SELECT event_id, x, y, zoom FROM u")
def from_quadkey(spark, d):
    k = _tiled(spark, d).select("event_id", T.quadkey("x", "y", "zoom").alias("key"))
    return k.select("event_id", T.quadkey_to_tile("key").alias("t")).select("event_id", "t.x", "t.y", "t.zoom")


@query("flip_tile_y", TILED + " SELECT event_id, CAST(pow(2, zoom) AS BIGINT) - 1 - y AS flipped FROM u")
def flip_tile_y(spark, d):
    return _tiled(spark, d).select("event_id", T.flip_tile_y("y", "zoom").alias("flipped"))


@query(
    "tile_shard",
    TILED + " SELECT event_id, (x + 2 * y) % 4 AS shard, (x % 4) + (y % 4) * 4 AS shard16 FROM u",
)
def tile_shard(spark, d):
    return _tiled(spark, d).select("event_id", T.tile_shard("x", "y", 4).alias("shard"), T.tile_shard_16("x", "y").alias("shard16"))


@query(
    "tile_bbox",
    TILED + f""" SELECT event_id, round({S.merc_lat('y * 256', 'zoom')}, 6) AS t_top, round({S.merc_lng('x * 256', 'zoom')}, 6) AS t_left,
 round({S.merc_lat('(y + 1) * 256', 'zoom')}, 6) AS t_bottom, round({S.merc_lng('(x + 1) * 256', 'zoom')}, 6) AS t_right FROM u""",
)
def tile_bbox(spark, d):
    b = T.tile_bbox(_tiled(spark, d), "zoom", x="x", y="y")
    return b.select("event_id", *[F.round(c, 6).alias(c) for c in ("t_top", "t_left", "t_bottom", "t_right")])


@query(
    "fit_zoom",
    f"""WITH p AS ({P.sql_points('customer', 'c_custkey', 'region', 'c_custkey')}),
r AS (SELECT c_custkey, lat AS r_bottom, lng AS r_left, lat + 0.02e0 * (c_custkey % 11) AS r_top, lng + 0.03e0 * (c_custkey % 13) AS r_right FROM p),
z AS (SELECT CAST(range AS INTEGER) AS z FROM range(2, 18)),
f AS (SELECT c_custkey, z, r_top = r_bottom OR r_left = r_right AS flat,
 {S.merc('r_bottom', 'r_right', 'z')[0]} - {S.merc('r_top', 'r_left', 'z')[0]} <= 810 AND {S.merc('r_bottom', 'r_right', 'z')[1]} - {S.merc('r_top', 'r_left', 'z')[1]} <= 610 AS ok FROM r, z)
SELECT c_custkey, CAST(CASE WHEN any_value(flat) THEN 8 ELSE greatest(2, coalesce(min(CASE WHEN NOT ok THEN z END) - 1, 17)) END AS INTEGER) AS fit_zoom FROM f GROUP BY 1""",
)
def fit_zoom(spark, d):
    p = P.customer_points(spark, d)
    k = F.col("c_custkey")
    p = p.withColumns(
        {"r_bottom": F.col("lat"), "r_left": F.col("lng"), "r_top": F.col("lat") + F.lit(0.02) * (k % 11),
         "r_right": F.col("lng") + F.lit(0.03) * (k % 13)}
    )
    return T.fit_zoom(p, 800, 600, 2, 17).select("c_custkey", "fit_zoom")


@query(
    "required_zoom",
    """WITH s AS (SELECT c_custkey, (1 + c_custkey % 9) * 0.5e0 AS vw, (1 + c_custkey % 7) * 0.25e0 AS vh, (c_custkey % 5) * 0.4e0 AS aw, (1 + c_custkey % 3) * 0.3e0 AS ah FROM customer),
q AS (SELECT c_custkey, CASE WHEN aw > 0 THEN greatest(3e0, 6 + log2(greatest(vw / aw, vh / ah))) ELSE 3e0 END AS z FROM s)
SELECT c_custkey, round(z, 6) AS required, CAST(greatest(3, ceil(z - 1e-9)) AS INTEGER) AS whole FROM q""",
)
def required_zoom(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    z = T.required_zoom(
        6.0, (k % 9 + 1) * F.lit(0.5), (k % 7 + 1) * F.lit(0.25), (k % 5) * F.lit(0.4), (k % 3 + 1) * F.lit(0.3), 3.0
    )
    c = c.withColumn("z", z)
    return c.select("c_custkey", F.round("z", 6).alias("required"), T.required_zoom_ceiling(F.col("z"), 3).alias("whole"))


@query("zoom_range_filter", TILED + " SELECT event_id, zoom, x, y FROM u WHERE zoom BETWEEN 5 AND 9")
def zoom_range_filter(spark, d):
    return T.zoom_range_filter(_tiled(spark, d), 5, 9)
