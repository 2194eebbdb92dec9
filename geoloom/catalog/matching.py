"""Matching of parts (held places) with orders-derived incoming rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom import rules
from geoloom.catalog import sql as S
from geoloom.catalog.places import CLASS_SQL, CLASSES, part
from geoloom.functions.core import beside_one_row
from geoloom.operators import matching as M
from geoloom.operators.proximity import connected_groups, near_pairs, point_columns
from geoloom.operators.utm import with_utm
from geoloom.registry import query
from geoloom.tables import table


def held(spark, d):
    """Parts as places; every ninth has no point."""
    k = F.col("p_partkey")
    p = with_utm(P.with_region(part(spark, d), "p_partkey"))
    gone = k % 9 == 4
    return p.select(
        k.alias("place_id"), F.col("p_name").alias("name"), "place", (k % 3).cast("string").alias("region"),
        F.when(k % 4 == 0, "").otherwise((k % 4).cast("string")).alias("district"), F.lit("node").alias("osm_type"),
        F.when(k % 2 == 0, k).otherwise(0).alias("osm_id"),
        *[F.when(~gone, F.col(c)).alias(c) for c in ("x", "y", "utm_zone", "lat", "lng")],
    )


def incoming(spark, d):
    """Customers as incoming places: names and points near those of parts."""
    c = table(spark, d, "customer").select("c_custkey")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    k = F.col("c_custkey")
    c = beside_one_row(c, p.agg(F.max("p_partkey").alias("__parts")))
    j = c.withColumn("p_partkey", k * 7 % F.col("__parts") + 1).drop("__parts").join(p, "p_partkey")
    j = P.with_region(j, "p_partkey").withColumns(
        {"lat": F.col("lat") + (k % 40) * F.lit(0.001), "lng": F.col("lng") + (k % 3) * F.lit(0.0005)}
    )
    j = with_utm(j)
    gone = k % 5 == 2
    return j.select(
        k.alias("place_id"), F.when(k % 8 == 7, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        F.element_at(F.array(*[F.lit(v) for v in CLASSES]), ((F.col("p_size") + k % 2) % 5 + 1).cast("int")).alias("place"),
        (F.col("p_partkey") % 3).cast("string").alias("region"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise((F.col("p_partkey") % 4).cast("string")).alias("district"),
        F.lit("Node").alias("osm_type"), F.when(k % 6 == 1, F.col("p_partkey")).otherwise(0).alias("osm_id"),
        *[F.when(~gone, F.col(c)).alias(c) for c in ("x", "y", "utm_zone", "lat", "lng")],
    )


def held_refs(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("place_id"), F.lit(0).alias("seq"), F.when(k % 2 == 0, rules.OSM).otherwise("Geo/Test").alias("provider"),
        (k % 700).cast("string").alias("external_id"), F.when(k % 4 == 0, "node").otherwise("way").alias("feature_type"),
    )


def incoming_refs(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("place_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), "c_custkey"
    ).select(
        "place_id", "seq", F.when(F.col("seq") == 0, F.upper(F.lit(rules.OSM))).otherwise("geo/test").alias("provider"),
        F.when(F.col("seq") == 0, k % 900).otherwise(k * 3 % 900).cast("string").alias("external_id"), F.lit("NODE").alias("feature_type"),
    )


HELD = f"""ph AS (SELECT p_partkey AS k, lower(p_name) AS nk0, {CLASS_SQL} AS cls, p_partkey % 3 AS rg, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_partkey % 4 AS VARCHAR) END AS ds, {P.SQL_REGION.format(k='p_partkey')} FROM part),
{S.utm_ctes('ph', 'hu')}, h AS (SELECT k, replace(nk0, ' ', '') AS nk, cls, rg, ds, CASE WHEN k % 9 <> 4 THEN ex END AS x, ny AS y, zone, lat, lng, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS osm FROM hu)"""
INC = f"""ci AS (SELECT c_custkey AS k, c_custkey * 7 % (SELECT max(p_partkey) FROM part) + 1 AS pk FROM customer), cj AS (SELECT ci.k, pk, lower(p_name) AS nk0, list_extract(['city','town','village','hamlet','isolated_dwelling'], CAST((p_size + ci.k % 2) % 5 AS INTEGER) + 1) AS cls, pk % 3 AS rg,
 CASE WHEN pk % 4 = 0 THEN '' ELSE CAST(pk % 4 AS VARCHAR) END AS ds, 5.5e0 + ((pk*7919) % 10000)/1e4 + (ci.k % 3) * 0.0005e0 AS lng, 49e0 + ((pk*104729) % 10000)/1e4 + (ci.k % 40) * 0.001e0 AS lat FROM ci JOIN part ON p_partkey = pk),
{S.utm_ctes('cj', 'iu')}, i AS (SELECT k, pk, replace(nk0, ' ', '') AS nk, cls, rg, ds, CASE WHEN k % 5 <> 2 THEN ex END AS x, ny AS y, zone, lat, lng, CASE WHEN k % 6 = 1 THEN pk ELSE 0 END AS osm FROM iu)"""
DIST = f"CASE WHEN i.zone = h.zone THEN sqrt(pow(i.x - h.x, 2) + pow(i.y - h.y, 2)) ELSE {S.hav('i.lat', 'i.lng', 'h.lat', 'h.lng', 6371000)} END"
LIMIT = "CASE icls WHEN 'city' THEN 8000 WHEN 'town' THEN 5000 WHEN 'village' THEN 2500 WHEN 'hamlet' THEN 1500 ELSE 800 END"
REFS = f"""hr AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'openstreetmap/overpass' ELSE 'geo/test' END AS pr, CAST(p_partkey % 700 AS VARCHAR) AS e, CASE WHEN p_partkey % 4 = 0 THEN 'node' ELSE 'way' END AS f FROM part),
ir AS (SELECT c_custkey AS k, 0 AS seq, 'openstreetmap/overpass' AS pr, CAST(c_custkey % 900 AS VARCHAR) AS e, 'node' AS f FROM customer UNION ALL SELECT c_custkey, 1, 'geo/test', CAST(c_custkey * 3 % 900 AS VARCHAR), 'node' FROM customer),
mr AS (SELECT ir.k AS k, arg_min(hr.k, (seq, hr.k)) AS hk FROM ir JOIN hr ON ir.pr = hr.pr AND ir.e = hr.e AND (ir.pr <> 'openstreetmap/overpass' OR ir.f = hr.f) GROUP BY 1)"""
OSMM = "mo AS (SELECT i.k, min(h.k) AS hk FROM i JOIN h ON i.osm > 0 AND h.osm = i.osm GROUP BY 1)"
CTX = "mc0 AS (SELECT i.k, h.k AS hk FROM i JOIN h ON i.nk = h.nk AND i.rg = h.rg AND i.ds = h.ds AND i.cls = h.cls), mc AS (SELECT k, min(hk) AS hk FROM mc0 GROUP BY 1 HAVING count(*) = 1)"
NEAR = f"""same AS (SELECT DISTINCT i.k FROM i JOIN h ON i.nk = h.nk AND i.cls = h.cls),
pool AS (SELECT i.k, h.k AS hk, i.cls AS icls, {DIST} AS m FROM i JOIN h ON i.nk = h.nk WHERE i.x IS NOT NULL AND h.x IS NOT NULL AND (h.cls = i.cls OR i.k NOT IN (SELECT k FROM same))
  AND (i.k NOT IN (SELECT k FROM mc) OR (i.k, h.k) IN (SELECT (k, hk) FROM mc))),
rk AS (SELECT *, row_number() OVER o AS rn, lead(m) OVER o AS m2 FROM pool WINDOW o AS (PARTITION BY k ORDER BY m, hk)),
mn AS (SELECT k, hk, m FROM rk WHERE rn = 1 AND m <= {LIMIT} AND (m2 IS NULL OR m <= 250 OR m2 - m >= 500))"""


@query("match_by_reference", f"WITH {REFS} SELECT k AS incoming_id, hk AS place_id FROM mr")
def match_by_reference(spark, d):
    return M.match_by_reference(incoming_refs(spark, d), held_refs(spark, d))


@query("match_by_osm_id", f"WITH {HELD}, {INC}, {OSMM} SELECT k AS incoming_id, hk AS place_id FROM mo")
def match_by_osm_id(spark, d):
    return M.match_by_osm_id(incoming(spark, d), held(spark, d))


@query("match_by_name", f"WITH {HELD}, {INC} SELECT i.k AS incoming_id, i.nk AS name_key, count(*) AS holders, min(h.k) AS first_id FROM i JOIN h ON i.nk = h.nk GROUP BY ALL")
def match_by_name(spark, d):
    n = M.match_by_name(M.place_names(incoming(spark, d)), M.place_names(held(spark, d)))
    return n.select("incoming_id", "name_key", "holders", "first_id")


@query("match_by_context", f"WITH {HELD}, {INC}, {CTX} SELECT k AS incoming_id, hk AS place_id FROM mc")
def match_by_context(spark, d):
    i, h = incoming(spark, d), held(spark, d)
    return M.match_by_context(i, M.place_names(i), h, M.place_names(h))


@query("match_nearest_unambiguous", f"WITH {HELD}, {INC}, {CTX}, {NEAR} SELECT k AS incoming_id, hk AS place_id, round(m, 2) AS metres FROM mn")
def match_nearest_unambiguous(spark, d):
    i, h = incoming(spark, d), held(spark, d)
    m = M.match_nearest_unambiguous(i, M.place_names(i), h, M.place_names(h))
    return m.select("incoming_id", "place_id", F.round("distance_m", 2).alias("metres"))


MATCHED = f"""{HELD}, {INC}, {REFS}, {OSMM}, {CTX}, {NEAR},
al AS (SELECT k, hk, 1 AS stage FROM mr UNION ALL SELECT k, hk, 2 FROM mo UNION ALL SELECT k, hk, 3 FROM mn UNION ALL SELECT mc.k, mc.hk, 4 FROM mc JOIN i ON i.k = mc.k AND i.x IS NULL),
ma AS (SELECT k, arg_min(hk, (stage, hk)) AS hk, CAST(min(stage) AS INTEGER) AS stage FROM al GROUP BY 1)"""


def matches(spark, d):
    i, h = incoming(spark, d), held(spark, d)
    return M.find_matches(i, M.place_names(i), incoming_refs(spark, d), h, M.place_names(h), held_refs(spark, d))


@query("find_matches", f"WITH {MATCHED} SELECT k AS incoming_id, hk AS place_id, stage FROM ma")
def find_matches(spark, d):
    return matches(spark, d)


@query(
    "find_existing",
    f"""WITH {HELD}, {INC}, {OSMM}, pool AS (SELECT i.k, h.k AS hk, i.cls AS icls, {DIST} AS m FROM i JOIN h ON i.nk = h.nk AND i.cls = h.cls WHERE i.x IS NOT NULL AND h.x IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m, hk) AS rn FROM pool), mn AS (SELECT k, hk FROM rk WHERE rn = 1 AND m <= {LIMIT}),
al AS (SELECT k, hk, 1 AS stage FROM mo UNION ALL SELECT k, hk, 2 FROM mn)
SELECT k AS incoming_id, arg_min(hk, stage) AS place_id, CAST(min(stage) AS INTEGER) AS stage FROM al GROUP BY 1""",
)
def find_existing(spark, d):
    i, h = incoming(spark, d), held(spark, d)
    return M.find_existing(i, M.place_names(i), h, M.place_names(h))


def relations(spark, d):
    """Incoming rows seen as boundary relations."""
    r = incoming(spark, d)
    return r.withColumn("relation_id", F.col("place_id")).drop("place_id", "osm_type", "osm_id")


def label_nodes(spark, d):
    """Every relation names two label nodes; some of them are held."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    c = beside_one_row(c, table(spark, d, "part").agg(F.max("p_partkey").alias("__parts")))
    near = (k * 7 % F.col("__parts") + 1).cast("bigint")
    return c.select(k.alias("relation_id"), F.explode(F.array(near, near + 64)).alias("node_id"))


LINKS = """ln AS (SELECT k, pk AS node FROM i UNION SELECT k, pk + 64 FROM i),
nd AS (SELECT k AS hk, osm AS node FROM h WHERE osm > 0 UNION SELECT k, CAST(e AS BIGINT) FROM hr WHERE pr = 'openstreetmap/overpass' AND f = 'node'),
ex AS (SELECT DISTINCT ln.k, nd.hk FROM ln JOIN nd ON ln.node = nd.node)"""


@query("explicit_link", f"WITH {HELD}, {INC}, {REFS}, {LINKS} SELECT k AS relation_id, hk AS place_id FROM ex")
def explicit_link(spark, d):
    return M.explicit_link(relations(spark, d), label_nodes(spark, d), held(spark, d), held_refs(spark, d))


@query(
    "link_relations",
    f"""WITH {HELD}, {INC}, {REFS}, {LINKS}, {CTX}, sh AS (SELECT DISTINCT ex.k, ex.hk FROM ex JOIN i ON i.k = ex.k JOIN h ON h.k = ex.hk AND h.nk = i.nk),
n1 AS (SELECT k, count(*) AS n, min(hk) AS hk FROM sh GROUP BY 1), so AS (SELECT k, hk, 1 AS stage FROM n1 WHERE n = 1),
{NEAR},
am AS (SELECT i.k, h.k AS hk, i.cls AS icls, {DIST} AS m FROM sh JOIN n1 ON n1.k = sh.k AND n > 1 JOIN i ON i.k = sh.k JOIN h ON h.k = sh.hk WHERE i.x IS NOT NULL AND h.x IS NOT NULL),
ar AS (SELECT *, row_number() OVER o AS rn, lead(m) OVER o AS m2 FROM am WINDOW o AS (PARTITION BY k ORDER BY m, hk))
SELECT k AS relation_id, hk AS place_id, stage FROM so UNION ALL SELECT k, hk, 1 FROM ar WHERE rn = 1 AND m <= {LIMIT} AND (m2 IS NULL OR m <= 250 OR m2 - m >= 500)
UNION ALL SELECT k, hk, 2 FROM mn WHERE k NOT IN (SELECT k FROM n1)""",
)
def link_relations(spark, d):
    r, h = relations(spark, d), held(spark, d)
    names = M.place_names(r.withColumnRenamed("relation_id", "place_id")).withColumnRenamed("place_id", "relation_id")
    return M.link_relations(r, names, label_nodes(spark, d), h, M.place_names(h), held_refs(spark, d))


@query(
    "attach_residential",
    f"""WITH {HELD}, ca AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE replace(lower(p_name), ' ', '') END AS nk, {P.SQL_REGION.format(k='s_suppkey*41')} FROM supplier JOIN part ON p_partkey = s_suppkey), {S.utm_ctes('ca', 'a31', '31')}, {S.utm_ctes('ca', 'a32', '32')}, a AS (SELECT * FROM a31 UNION ALL SELECT * FROM a32),
nm AS (SELECT a.k, h.k AS hk, sqrt(pow(a.ex - h.x, 2) + pow(a.ny - h.y, 2)) AS m, a.nk = h.nk AS named FROM a JOIN h ON a.zone = h.zone AND h.x IS NOT NULL),
r1 AS (SELECT k, arg_min(hk, (m, hk)) AS hk FROM nm WHERE named GROUP BY 1), r2 AS (SELECT k, arg_min(hk, (m, hk)) AS hk FROM nm WHERE m <= 8000 AND k NOT IN (SELECT k FROM r1) GROUP BY 1)
SELECT k AS area_id, hk AS place_id FROM r1 UNION ALL SELECT k, hk FROM r2""",
)
def attach_residential(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    a = s.join(p, "s_suppkey").withColumn("__k", F.col("s_suppkey") * 41)
    a = P.with_region(a, "__k")
    areas = a.select(F.col("s_suppkey").alias("area_id"), F.when(F.col("s_suppkey") % 3 == 0, "none").otherwise(F.col("p_name")).alias("name"), "lat", "lng")
    return M.attach_residential(areas, held(spark, d))


SAME = f"""{HELD}, {REFS}, ed AS (SELECT a.k AS a, b.k AS b FROM hr a JOIN hr b ON a.k <> b.k AND a.pr = b.pr AND a.e = b.e AND (a.pr <> 'openstreetmap/overpass' OR a.f = b.f)
 UNION SELECT i.k, h.k FROM h i JOIN h ON i.k <> h.k AND i.nk = h.nk AND i.cls = h.cls AND i.x IS NOT NULL AND h.x IS NOT NULL AND {DIST} <= 100)"""


@query(
    "same_instance",
    f"""WITH RECURSIVE {SAME}, rc AS (SELECT k AS n, k AS l FROM h UNION SELECT ed.b, rc.l FROM rc JOIN ed ON ed.a = rc.n)
SELECT n AS place_id, min(l) AS group_id FROM rc GROUP BY 1""",
)
def same_instance(spark, d):
    h = held(spark, d)
    return M.same_instance_groups(h, M.place_names(h), held_refs(spark, d))
