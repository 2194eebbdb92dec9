"""Distances, bearings, rectangles and projected coordinates over the point views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import sql as S
from geoloom.catalog.tiles import AREA_SQL, EV, areas
from geoloom.functions import geodesy as G
from geoloom.functions import rects as R
from geoloom.operators import affine as A
from geoloom.operators import utm as U
from geoloom.registry import query
from geoloom.tables import table

PAIRS = f"""WITH p AS ({EV}), q AS (SELECT event_id, lat, lng,
 49e0 + ((event_id*31) % 10000)/1e4 AS lat2, 5.5e0 + ((event_id*17) % 10000)/1e4 AS lng2 FROM p)"""


def _pairs(spark, d):
    k = F.col("event_id")
    return P.event_points(spark, d).withColumns(
        {"lat2": F.lit(49.0) + (k * 31 % 10000) / F.lit(1e4), "lng2": F.lit(5.5) + (k * 17 % 10000) / F.lit(1e4)}
    )


@query("with_distance_km", PAIRS + f" SELECT event_id, round({S.hav('lat', 'lng', 'lat2', 'lng2', 6378.137)}, 6) AS km FROM q")
def with_distance_km(spark, d):
    return _pairs(spark, d).select("event_id", F.round(G.distance_km("lat", "lng", "lat2", "lng2"), 6).alias("km"))


@query(
    "with_bearing",
    PAIRS + """ SELECT event_id, round(fmod(degrees(atan2(sin(radians(lng2 - lng)) * cos(radians(lat2)),
 cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lng2 - lng)))) + 360, 360), 6) AS bearing FROM q""",
)
def with_bearing(spark, d):
    return _pairs(spark, d).select("event_id", F.round(G.bearing("lat", "lng", "lat2", "lng2"), 6).alias("bearing"))


@query(
    "with_destination",
    PAIRS + """, s AS (SELECT event_id, radians(lat) AS f, radians(lng) AS l, radians(CAST(event_id % 360 AS DOUBLE)) AS b, (event_id % 500) / 6371e0 AS d FROM q),
 t AS (SELECT *, asin(sin(f) * cos(d) + cos(f) * sin(d) * cos(b)) AS f2 FROM s)
 SELECT event_id, round(degrees(f2), 6) AS to_lat, round(degrees(l + atan2(sin(b) * sin(d) * cos(f), cos(d) - sin(f) * sin(f2))), 6) AS to_lng FROM t""",
)
def with_destination(spark, d):
    k = F.col("event_id")
    to = G.destination("lat", "lng", (k % 360).cast("double"), (k % 500).cast("double"))
    return _pairs(spark, d).withColumn("to", to).select(
        "event_id", F.round("to.lat", 6).alias("to_lat"), F.round("to.lng", 6).alias("to_lng")
    )


@query(
    "with_pixel_distance",
    "SELECT l_orderkey, l_linenumber, round(sqrt(pow(l_partkey - l_suppkey, 2) + pow(l_partkey % 97 - l_suppkey % 89, 2)), 6) AS pixels FROM lineitem",
)
def with_pixel_distance(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    px = G.pixel_distance("l_partkey", F.col("l_partkey") % 97, "l_suppkey", F.col("l_suppkey") % 89)
    return li.select("l_orderkey", "l_linenumber", F.round(px, 6).alias("pixels"))


A_, F_ = G.WGS84_AXIS, G.WGS84_FLATTENING


@query(
    "with_ecef",
    f"""WITH p AS ({EV}), q AS (SELECT event_id, radians(lat) AS f, radians(lng) AS l, CAST(event_id % 9000 AS DOUBLE) AS h,
 {S.n(A_)} / sqrt(1 - {S.n(F_ * (2 - F_))} * pow(sin(radians(lat)), 2)) AS n FROM p)
SELECT event_id, round((n + h) * cos(f) * cos(l), 3) AS x, round((n + h) * cos(f) * sin(l), 3) AS y, round((n * {S.n((1 - F_) ** 2)} + h) * sin(f), 3) AS z FROM q""",
)
def with_ecef(spark, d):
    e = G.to_ecef("lat", "lng", (F.col("event_id") % 9000).cast("double"))
    return P.event_points(spark, d).withColumn("e", e).select(
        "event_id", *[F.round(f"e.{c}", 3).alias(c) for c in ("x", "y", "z")]
    )


@query("from_ecef", f"WITH p AS ({EV}) SELECT event_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM p")
def from_ecef(spark, d):
    p = P.event_points(spark, d).withColumn("e", G.to_ecef("lat", "lng"))
    p = p.withColumn("g", G.from_ecef("e.x", "e.y", "e.z"))
    return p.select("event_id", F.round("g.lat", 6).alias("lat"), F.round("g.lng", 6).alias("lng"))


# ---- UTM and MGRS ----

OWN = f"WITH p AS ({EV}), {S.utm_ctes('p', 'u')}"
BAND = f"substr('{U.BANDS}', CAST(least(greatest(floor((lat + 80) / 8), 0), 19) AS INTEGER) + 1, 1)"


@query("with_utm", OWN + f" SELECT event_id, round(ex, 3) AS x, round(ny, 3) AS y, zone AS utm_zone, {BAND} AS utm_band FROM u")
def with_utm(spark, d):
    u = U.with_utm(P.event_points(spark, d))
    return u.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "utm_zone", "utm_band")


@query(
    "with_utm_forced_zone",
    f"WITH p AS ({P.sql_points('customer', 'c_custkey', 'region', 'c_custkey')}), {S.utm_ctes('p', 'u', '31')} SELECT c_custkey, round(ex, 3) AS x, round(ny, 3) AS y FROM u",
)
def with_utm_forced_zone(spark, d):
    u = U.with_utm(P.customer_points(spark, d), 31)
    return u.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("from_utm", f"WITH p AS ({EV}) SELECT event_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM p")
def from_utm(spark, d):
    u = U.with_utm(P.event_points(spark, d)).drop("lat", "lng")
    return U.from_utm(u).select("event_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    "reproject_zone",
    f"WITH p AS ({P.sql_points('orders', 'o_orderkey', 'region', 'o_orderkey')}), {S.utm_ctes('p', 'u', '32')} SELECT o_orderkey, round(ex, 2) AS x, round(ny, 2) AS y FROM u",
)
def reproject_zone(spark, d):
    o = P.with_region(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    u = U.reproject_zone(U.with_utm(o), 32, stored_lat="lat", stored_lng="lng")
    return u.select("o_orderkey", F.round("rx", 2).alias("x"), F.round("ry", 2).alias("y"))


@query("utm_zone", f"WITH p AS ({EV}) SELECT event_id, CAST(least(60, floor((lng + 180) / 6) + 1) AS INTEGER) AS utm_zone, {BAND} AS utm_band FROM p")
def utm_zone(spark, d):
    return P.event_points(spark, d).select("event_id", U.utm_zone("lng").alias("utm_zone"), U.utm_band("lat").alias("utm_band"))


@query("format_utm", OWN + f" SELECT event_id, printf('%d%s %.2f E %.2f N', zone, {BAND}, ex, ny) AS text FROM u")
def format_utm(spark, d):
    return U.with_utm(P.event_points(spark, d)).select("event_id", U.format_utm().alias("text"))


@query(
    "with_mgrs",
    OWN + f""" SELECT event_id, printf('%d%s %s%s %05d %05d', zone, {BAND},
 substr(CASE (zone - 1) % 3 WHEN 0 THEN 'ABCDEFGH' WHEN 1 THEN 'JKLMNPQR' ELSE 'STUVWXYZ' END, CAST(floor(ex / 100000) AS INTEGER), 1),
 substr('{U.ROWS}', CAST((floor(ny / 100000) + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 AS INTEGER) + 1, 1),
 CAST(floor(fmod(ex, 100000)) AS INTEGER), CAST(floor(fmod(ny, 100000)) AS INTEGER)) AS mgrs FROM u""",
)
def with_mgrs(spark, d):
    return U.with_utm(P.event_points(spark, d)).select("event_id", U.mgrs_text().alias("mgrs"))


@query("from_mgrs", OWN + f" SELECT event_id, CAST(floor(ex) AS BIGINT) AS x, CAST(floor(ny) AS BIGINT) AS y, zone AS utm_zone, {BAND} AS utm_band FROM u")
def from_mgrs(spark, d):
    m = U.with_utm(P.event_points(spark, d)).select("event_id", U.mgrs_text().alias("mgrs"))
    p = U.parse_mgrs(m, "mgrs")
    return p.select("event_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "utm_zone", "utm_band")


@query(
    "bulk_parse_coordinates",
    f"""WITH p AS ({EV}) SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'degrees' WHEN 1 THEN 'degrees' WHEN 2 THEN 'utm' WHEN 3 THEN 'utm' WHEN 4 THEN 'mgrs' END AS kind,
 event_id % 6 <> 5 AS close FROM p""",
)
def bulk_parse_coordinates(spark, d):
    """Texts of six shapes are derived from the points, then read back."""
    u = U.with_utm(P.event_points(spark, d)).withColumnRenamed("lat", "true_lat").withColumnRenamed("lng", "true_lng")
    k = F.col("event_id") % 6
    deg = F.format_string("%.4f, %.4f", F.col("true_lat"), F.col("true_lng"))
    commas = F.translate(F.format_string("  lat %.4f / lng %.4f ", F.col("true_lat"), F.col("true_lng")), ".", ",")
    text = (
        F.when(k == 0, deg).when(k == 1, commas).when(k == 2, U.format_utm())
        .when(k == 3, F.format_string("UTM %d%s %.2f %.2f", "utm_zone", "utm_band", "x", "y"))
        .when(k == 4, U.mgrs_text()).otherwise("no position given")
    )
    p = U.parse_coordinates(u.withColumn("text", text), "text")
    # metre squares hold a point to 1.5 m; near the poles that is more longitude
    close = (F.abs(F.col("lat") - F.col("true_lat")) < 2e-5) & (
        F.abs(F.col("lng") - F.col("true_lng")) * F.cos(F.radians("true_lat")) < 2e-5
    )
    return p.select("event_id", "kind", F.coalesce(close, F.lit(False)).alias("close"))


@query(
    "with_distance_m",
    f"""WITH p AS ({P.sql_points('customer', 'c_custkey', 'region', 'c_custkey')}), {S.utm_ctes('p', 'u')},
w AS (SELECT *, lag(ex) OVER o AS px, lag(ny) OVER o AS py, lag(zone) OVER o AS pz, lag(lat) OVER o AS pla, lag(lng) OVER o AS pln FROM u WINDOW o AS (PARTITION BY c_custkey % 97 ORDER BY c_custkey))
SELECT c_custkey, round(CASE WHEN zone = pz THEN sqrt(pow(ex - px, 2) + pow(ny - py, 2)) ELSE {S.hav('pla', 'pln', 'lat', 'lng', 6371000)} END, 3) AS metres FROM w""",
)
def with_distance_m(spark, d):
    u = U.with_utm(P.customer_points(spark, d)).withColumn("g", F.col("c_custkey") % 97)
    o = W.partitionBy("g").orderBy("c_custkey")
    for c in ("x", "y", "utm_zone", "lat", "lng"):
        u = u.withColumn(f"p_{c}", F.lag(c).over(o))
    m = G.projected_distance_m(
        dict(x="p_x", y="p_y", zone="p_utm_zone", lat="p_lat", lng="p_lng"),
        dict(x="x", y="y", zone="utm_zone", lat="lat", lng="lng"),
    )
    return u.select("c_custkey", F.round(m, 3).alias("metres"))


# ---- affine calibration: the four corners of each brand's parts as control points ----


@query(
    "fit_affine",
    """WITH c AS (SELECT l_suppkey AS image, CAST(l_partkey % 1000 AS DOUBLE) AS px, CAST(l_orderkey % 800 AS DOUBLE) AS py FROM lineitem),
g AS (SELECT image, regr_count(px, py) AS n FROM c GROUP BY 1)
SELECT image, round(0.5e0, 6) AS e_a, round(-0.02e0, 6) AS e_b, round(400000e0 + image, 3) AS e_c, round(0.03e0, 6) AS n_a, round(-0.5e0, 6) AS n_b, round(5500000e0, 3) AS n_c FROM g WHERE n >= 4""",
)
def fit_affine(spark, d):
    return _fits(spark, d).select(
        "image", *[F.round(c, 3 if c.endswith("c") else 6).alias(c) for c in ("e_a", "e_b", "e_c", "n_a", "n_b", "n_c")]
    )


def _controls(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), "l_orderkey", "l_linenumber", "l_partkey")
    li = li.withColumns({"px": (F.col("l_partkey") % 1000).cast("double"), "py": (F.col("l_orderkey") % 800).cast("double")})
    return li.withColumns(
        {
            "e": F.lit(0.5) * F.col("px") - F.lit(0.02) * F.col("py") + 400000.0 + F.col("image"),
            "n": F.lit(0.03) * F.col("px") - F.lit(0.5) * F.col("py") + 5500000.0,
        }
    )


def _fits(spark, d):
    return A.fit_affine(_controls(spark, d), "image", "px", "py", {"e": "e", "n": "n"})


@query(
    "apply_affine",
    "SELECT l_orderkey, l_linenumber, round(0.5e0 * (l_partkey % 1000) - 0.02e0 * (l_orderkey % 800) + 400000 + l_suppkey, 2) AS e, round(0.03e0 * (l_partkey % 1000) - 0.5e0 * (l_orderkey % 800) + 5500000, 2) AS n FROM lineitem",
)
def apply_affine(spark, d):
    j = _controls(spark, d).drop("e", "n").join(_fits(spark, d), "image")
    return j.select(
        "l_orderkey", "l_linenumber", F.round(A.apply_affine("px", "py", "e"), 2).alias("e"),
        F.round(A.apply_affine("px", "py", "n"), 2).alias("n"),
    )


@query("invert_affine", "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 1000 AS DOUBLE) AS px, CAST(l_orderkey % 800 AS DOUBLE) AS py FROM lineitem")
def invert_affine(spark, d):
    j = _controls(spark, d).drop("px", "py").join(_fits(spark, d).withColumnsRenamed({"e_a": "e_a"}), "image")
    x, y = A.invert_affine("e", "n")
    return j.select("l_orderkey", "l_linenumber", F.round(x, 2).alias("px"), F.round(y, 2).alias("py"))


# ---- rectangles ----

BOX = dict(top=60.0, left=-30.0, bottom=-20.0, right=95.5)


@query("in_bounds_half_open", f"WITH p AS ({EV}) SELECT event_id FROM p WHERE lng >= -30 AND lng < 95.5e0 AND lat <= 60 AND lat > -20")
def in_bounds_half_open(spark, d):
    return P.event_points(spark, d).filter(R.in_bounds("lat", "lng", R.rect_of(**BOX))).select("event_id")


@query("in_bounds_closed", f"WITH p AS ({EV}) SELECT event_id FROM p WHERE lng BETWEEN -30 AND 95.5e0 AND lat BETWEEN -20 AND 60")
def in_bounds_closed(spark, d):
    swapped = R.rect_of(BOX["bottom"], BOX["right"], BOX["top"], BOX["left"])
    return P.event_points(spark, d).filter(R.in_bounds("lat", "lng", swapped, "closed")).select("event_id")


TWO = f"""WITH a AS ({AREA_SQL}), b AS (SELECT n_nationkey AS k2, r_top AS t2, r_left AS l2, r_bottom AS b2, r_right AS x2 FROM a),
 o AS (SELECT o_orderkey, o_custkey % 25 AS i, o_orderkey % 25 AS j FROM orders),
 j AS (SELECT * FROM o JOIN a ON a.n_nationkey = o.i JOIN b ON b.k2 = o.j)"""


def _two(spark, d):
    """Order rows, each with two of the nation rectangles (25 rows, broadcast)."""
    a = areas(spark, d)
    b = a.select(F.col("n_nationkey").alias("k2"), *[F.col(f"r_{s}").alias(f"s_{s}") for s in ("top", "left", "bottom", "right")])
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("i"), (F.col("o_orderkey") % 25).alias("j"))
    return o.join(a, F.col("i") == F.col("n_nationkey")).join(b, F.col("j") == F.col("k2"))


@query("rect_contains", TWO + " SELECT o_orderkey FROM j WHERE r_left <= l2 AND x2 <= r_right AND r_top >= t2 AND b2 >= r_bottom")
def rect_contains(spark, d):
    return _two(spark, d).filter(R.rect_contains(R.rect("r"), R.rect("s"))).select("o_orderkey")


@query("rect_intersects", TWO + " SELECT o_orderkey FROM j WHERE r_left < x2 AND r_top > b2 AND r_right > l2 AND r_bottom < t2")
def rect_intersects(spark, d):
    return _two(spark, d).filter(R.rect_intersects(R.rect("r"), R.rect("s"))).select("o_orderkey")


def _rounded(r, prefix="o"):
    return [F.round(c, 9).alias(n) for n, c in r.columns(prefix).items()]


@query(
    "rect_intersection",
    TWO + """, k AS (SELECT o_orderkey, least(r_top, t2) AS t, greatest(r_left, l2) AS l, greatest(r_bottom, b2) AS b, least(r_right, x2) AS r FROM j)
 SELECT o_orderkey, CASE WHEN r >= l AND t >= b THEN round(t, 9) END AS o_top, CASE WHEN r >= l AND t >= b THEN round(l, 9) END AS o_left,
 CASE WHEN r >= l AND t >= b THEN round(b, 9) END AS o_bottom, CASE WHEN r >= l AND t >= b THEN round(r, 9) END AS o_right FROM k""",
)
def rect_intersection(spark, d):
    return _two(spark, d).select("o_orderkey", *_rounded(R.rect_intersection(R.rect("r"), R.rect("s"))))


@query("rect_union", TWO + " SELECT o_orderkey, round(greatest(r_top, t2), 9) AS o_top, round(least(r_left, l2), 9) AS o_left, round(least(r_bottom, b2), 9) AS o_bottom, round(greatest(r_right, x2), 9) AS o_right FROM j")
def rect_union(spark, d):
    return _two(spark, d).select("o_orderkey", *_rounded(R.rect_union(R.rect("r"), R.rect("s"))))


@query(
    "rect_shape",
    TWO + """ SELECT o_orderkey, round(r_top + 0.5e0, 6) AS inf_top, round(r_right + 0.25e0, 6) AS inf_right, round(r_top - 0.1e0, 6) AS off_top, round(r_left + 0.2e0, 6) AS off_left,
 round((r_top + r_bottom) / 2, 6) AS mid_lat, round((r_left + r_right) / 2, 6) AS mid_lng, round(r_top - r_bottom, 6) AS height, round(r_right - r_left, 6) AS width FROM j""",
)
def rect_shape(spark, d):
    """Inflate, offset, center and size."""
    r = R.rect("r")
    i, o = R.rect_inflate(r, 0.5, 0.25), R.rect_offset(r, 0.1, 0.2)
    (la, ln), (h, w) = R.rect_center(r), R.rect_size(r)
    vals = dict(inf_top=i.top, inf_right=i.right, off_top=o.top, off_left=o.left, mid_lat=la, mid_lng=ln, height=h, width=w)
    return _two(spark, d).select("o_orderkey", *[F.round(v, 6).alias(k) for k, v in vals.items()])


@query(
    "normalize_bounds",
    PAIRS + " SELECT event_id, greatest(lat, lat2) AS o_top, least(lng, lng2) AS o_left, least(lat, lat2) AS o_bottom, greatest(lng, lng2) AS o_right FROM q",
)
def normalize_bounds(spark, d):
    r = R.normalize_bounds("lat", "lng", "lat2", "lng2")
    return _pairs(spark, d).select("event_id", *[c.alias(n) for n, c in r.columns("o").items()])


@query(
    "pad_bounds_km",
    PAIRS + """, r AS (SELECT event_id, greatest(lat, lat2) AS t, least(lng, lng2) AS l, least(lat, lat2) AS b, greatest(lng, lng2) AS r, 1 + event_id % 20 AS km FROM q),
 c AS (SELECT *, abs(cos(radians((t + b) / 2))) AS k FROM r)
 SELECT event_id, round(t + km / 111.32e0, 6) AS o_top, round(l - km / (111.32e0 * greatest(k, 0.1e0)), 6) AS o_left, round(b - km / 111.32e0, 6) AS o_bottom, round(r + km / (111.32e0 * greatest(k, 0.1e0)), 6) AS o_right FROM c""",
)
def pad_bounds_km(spark, d):
    r = R.pad_bounds_km(R.normalize_bounds("lat", "lng", "lat2", "lng2"), F.col("event_id") % 20 + 1)
    return _pairs(spark, d).select("event_id", *[F.round(c, 6).alias(n) for n, c in r.columns("o").items()])


@query(
    "snap_padding",
    "SELECT event_id, CASE WHEN isnan(value) OR value < 1 OR value > 20 THEN 1e0 ELSE round(value / 0.5e0) * 0.5e0 END AS padding FROM events",
)
def snap_padding(spark, d):
    return table(spark, d, "events").select("event_id", R.snap_padding("value").alias("padding"))


@query(
    "clamp_to_bounds",
    f"""WITH p AS ({EV}), c AS (SELECT *, lng >= -30 AND lng < 95.5e0 AND lat <= 60 AND lat > -20 AS ok, least(greatest(lat, -20e0), 60e0) AS a, least(greatest(lng, -30e0), 95.5e0) AS n FROM p)
SELECT event_id, round(CASE WHEN ok THEN lat WHEN a = 60 THEN 60 - 0.08e0 WHEN a = -20 THEN -20 + 0.08e0 ELSE a END, 6) AS lat,
 round(CASE WHEN ok THEN lng WHEN n = -30 THEN -30 + 0.1255e0 WHEN n = 95.5e0 THEN 95.5e0 - 0.1255e0 ELSE n END, 6) AS lng FROM c""",
)
def clamp_to_bounds(spark, d):
    la, ln = R.clamp_to_bounds("lat", "lng", R.rect_of(**BOX))
    return P.event_points(spark, d).select("event_id", F.round(la, 6).alias("lat"), F.round(ln, 6).alias("lng"))


@query(
    "same_point",
    f"""WITH p AS ({P.sql_points('orders', 'o_orderkey', 'region', 'o_orderkey, o_custkey')}), c AS (SELECT c_custkey, {P.SQL_REGION.format(k='c_custkey')} FROM customer)
SELECT o_orderkey, abs(p.lat - c.lat) < 1e-6 AND abs(p.lng - c.lng) < 1e-6 AS same FROM p JOIN c ON c.c_custkey = p.o_custkey""",
)
def same_point(spark, d):
    o = P.with_region(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    c = P.customer_points(spark, d).select("c_custkey", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", R.same_point("lat", "lng", "lat2", "lng2").alias("same"))


@query(
    "pixel_rects",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS x, l_suppkey % 400 AS y, 20 + l_linenumber * 10 AS w, 30 + l_linenumber * 5 AS h, l_orderkey % 500 AS x2, l_partkey % 400 AS y2, 60 AS w2, 50 AS h2 FROM lineitem)
SELECT l_orderkey, l_linenumber, x2 >= x AND x2 < x + w AND y2 >= y AND y2 < y + h AS holds, x2 < x + w AND x < x2 + w2 AND y2 < y + h AND y < y2 + h2 AS meets,
 CASE WHEN least(x + w, x2 + w2) >= greatest(x, x2) AND least(y + h, y2 + h2) >= greatest(y, y2) THEN least(x + w, x2 + w2) - greatest(x, x2) END AS overlap_w,
 greatest(x + w, x2 + w2) - least(x, x2) AS union_w, x - 5 AS inflated_x, w + 10 AS inflated_w FROM r""",
)
def pixel_rects(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = F.col("l_linenumber").cast("bigint")
    a = R.PixelRect(F.col("l_partkey") % 500, F.col("l_suppkey") % 400, n * 10 + 20, n * 5 + 30)
    b = R.PixelRect(F.col("l_orderkey") % 500, F.col("l_partkey") % 400, F.lit(60).cast("bigint"), F.lit(50).cast("bigint"))
    i = R.pixel_inflate(a, 5, 5)
    return li.select(
        "l_orderkey", "l_linenumber", R.pixel_contains(a, b.x, b.y).alias("holds"), R.pixel_intersects(a, b).alias("meets"),
        R.pixel_intersection(a, b).w.alias("overlap_w"), R.pixel_union(a, b).w.alias("union_w"),
        i.x.alias("inflated_x"), i.w.alias("inflated_w"),
    )


# ---- extents ----


@query("extent", f"WITH p AS ({EV.replace('event_id, user_id, ts', 'event_type')}) SELECT event_type, max(lat) AS top, min(lng) AS left_, min(lat) AS bottom, max(lng) AS right_ FROM p GROUP BY 1")
def extent(spark, d):
    from geoloom.operators.summaries import extent as ext

    return ext(P.event_points(spark, d), "event_type").withColumnsRenamed({"left": "left_", "right": "right_"})
