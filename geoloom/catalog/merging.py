"""Upserts and merges over candidates derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import rules
from geoloom.catalog import matching as C
from geoloom.catalog.matching import MATCHED
from geoloom.operators import merging as M
from geoloom.registry import query
from geoloom.tables import table

SEQ = "(l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey"


def rows(spark, d):
    """Odd orders are held, even ones come in."""
    li = table(spark, d, "lineitem")
    s, o = F.col("l_suppkey"), F.col("l_orderkey")
    seq = (o * 10 + F.col("l_linenumber")) * 100000 + s
    return li.select(
        F.col("l_partkey").alias("place_id"), F.concat(F.lit("P"), s % 4).alias("provider"), (s % 3).cast("string").alias("external_id"),
        (s % 50).cast("int").alias("priority"), (o % 90).cast("int").alias("score"), seq.alias("updated_at"),
        F.concat(F.lit("R"), s % 6).alias("ring_text"), F.when(o % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("h"), o % 3)).alias("holes_text"),
        F.when(o % 7 == 0, 0).otherwise(o % 60).cast("int").alias("utm_zone"), F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("b"), s % 9)).alias("boundary"),
        F.lit("").alias("admin_level"), (s % 11 == 0).alias("explicit_link"), (o % 2).alias("held"), F.col("l_returnflag").alias("flag"), s.alias("s"), seq.alias("seq"),
    )


SRC = f"""r AS (SELECT l_partkey AS p, 'P' || (l_suppkey % 4) AS pr, CAST(l_suppkey % 3 AS VARCHAR) AS e, CAST(l_suppkey % 50 AS INTEGER) AS prio, CAST(l_orderkey % 90 AS INTEGER) AS score, {SEQ} AS u, 'R' || (l_suppkey % 6) AS rt,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'h' || (l_orderkey % 3) END AS ht, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_orderkey % 60 END AS z, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'b' || (l_suppkey % 9) END AS b, l_suppkey % 11 = 0 AS lk, 1 - l_orderkey % 2 AS turn, l_returnflag AS flag, l_suppkey AS s FROM lineitem)"""


def split(spark, d):
    r = rows(spark, d)
    return r.filter("held = 1"), r.filter("held = 0")


@query(
    "upsert_centers",
    f"WITH {SRC}, x AS (SELECT *, row_number() OVER (PARTITION BY p, pr, e ORDER BY turn DESC, u DESC) AS rn FROM r) SELECT p AS place_id, pr AS provider, e AS external_id, prio AS priority, CASE WHEN turn = 1 THEN 0 ELSE score END AS score, u AS updated_at FROM x WHERE rn = 1",
)
def upsert_centers(spark, d):
    held, new = split(spark, d)
    return M.upsert_centers(held, new).select("place_id", "provider", "external_id", "priority", "score", "updated_at")


@query(
    "upsert_polygons",
    f"""WITH {SRC} SELECT p AS place_id, rt AS ring_text, pr AS provider, arg_max(e, (turn, u)) AS external_id, arg_max(prio, (turn, u)) AS priority, CAST(coalesce(arg_max(z, (turn, u)) FILTER (z > 0), NULL) AS INTEGER) AS utm_zone,
 arg_max(b, (turn, u)) FILTER (b <> '') AS boundary, arg_max(ht, (turn, u)) FILTER (ht IS NOT NULL) AS holes_text, bool_or(lk) AS explicit_link, CASE WHEN max(turn) = 1 THEN 0 ELSE arg_max(score, (turn, u)) END AS score FROM r GROUP BY ALL""",
)
def upsert_polygons(spark, d):
    held, new = split(spark, d)
    return M.upsert_polygons(held, new).select(
        "place_id", "ring_text", "provider", "external_id", "priority", "utm_zone", "boundary", "holes_text", "explicit_link", "score"
    )


@query("upsert_references", f"WITH {SRC} SELECT DISTINCT p AS place_id, pr AS provider, e AS external_id, flag AS feature_type FROM r")
def upsert_references(spark, d):
    r = rows(spark, d).withColumn("feature_type", F.col("flag"))
    held, new = r.filter("held = 1"), r.filter("held = 0").withColumn("provider", F.lower("provider"))
    m = M.upsert_references(held, new)
    return m.select("place_id", F.upper("provider").alias("provider"), "external_id", "feature_type")


@query("merge_aliases", f"WITH {SRC} SELECT p AS place_id, count(DISTINCT rt) AS aliases, min(u) AS first_seq FROM (SELECT p, rt, u + turn * 1000000000000 AS u FROM r) GROUP BY 1")
def merge_aliases(spark, d):
    r = rows(spark, d).select("place_id", "seq", F.col("ring_text").alias("alias"), "held")
    held, new = r.filter("held = 1").drop("held"), r.filter("held = 0").drop("held").withColumns({"alias": F.concat(F.lower("alias"), F.lit(" ")), "seq": F.col("seq") + 1000000000000})
    m = M.merge_aliases(held, new)
    return m.groupBy("place_id").agg(F.count(F.lit(1)).alias("aliases"), F.min("seq").alias("first_seq"))


@query(
    "restore_provider",
    f"""WITH {SRC}, b AS (SELECT DISTINCT p, pr, rt FROM r WHERE turn = 0), a AS (SELECT p, pr, rt, bool_and(flag = 'R') AS rej FROM r WHERE turn = 1 GROUP BY ALL),
got AS (SELECT DISTINCT p FROM a WHERE pr = 'P1' AND NOT rej), o AS (SELECT p_partkey AS p, p_partkey % 3 = 0 AS tr, p_partkey % 2 = 0 AS rc FROM part WHERE p_partkey NOT IN (SELECT p FROM got))
SELECT p AS place_id, pr AS provider, rt AS ring_text FROM a WHERE pr <> 'P1' UNION SELECT p, pr, rt FROM a WHERE pr = 'P1' AND p NOT IN (SELECT p FROM o WHERE NOT tr AND NOT rc) UNION SELECT b.p, pr, rt FROM b JOIN o ON o.p = b.p AND tr WHERE pr = 'P1'""",
)
def restore_provider(spark, d):
    held, new = split(spark, d)
    before = held.select("place_id", "provider", "ring_text", F.lit(False).alias("rejected")).distinct()
    after = new.groupBy("place_id", "provider", "ring_text").agg(F.bool_and(F.col("flag") == "R").alias("rejected"))
    k = F.col("p_partkey")
    out = table(spark, d, "part").select(k.alias("place_id"), (k % 3 == 0).alias("transient"), (k % 2 == 0).alias("received"))
    return M.restore_provider(before, after, out, "p1").select("place_id", "provider", "ring_text")


@query("stale_geometry_keys", f"WITH {SRC} SELECT p || '' AS place_key, rt AS geometry_key FROM r WHERE turn = 0 EXCEPT SELECT p || '', rt FROM r WHERE turn = 1")
def stale_geometry_keys(spark, d):
    r = rows(spark, d).select(F.col("place_id").cast("string").alias("place_key"), F.col("ring_text").alias("geometry_key"), "held")
    return M.stale_geometry_keys(r.filter("held = 1").distinct(), r.filter("held = 0"))


@query("prune_missing_provider", f"WITH {SRC} SELECT p AS place_id, u AS seq FROM r WHERE pr <> 'P2' OR p % 4 <> 1")
def prune_missing_provider(spark, d):
    listed = table(spark, d, "part").select(F.col("p_partkey").alias("place_id")).filter("place_id % 4 <> 1")
    return M.prune_missing_provider(rows(spark, d), listed, "p2").select("place_id", "seq")


@query("has_provider_polygon", f"WITH {SRC} SELECT p_partkey AS place_id FROM part WHERE p_partkey IN (SELECT p FROM r WHERE pr = 'P3' AND flag = 'A' AND lk)")
def has_provider_polygon(spark, d):
    c = rows(spark, d).withColumns({"rejected_by_containment": F.col("flag") != "A", "rejected_by_geometry": ~F.col("explicit_link")})
    return M.has_provider_polygon(table(spark, d, "part").select(F.col("p_partkey").alias("place_id")), c, "p3")


# ---- whole snapshots ----


def _bare(df, extra=()):
    return df.withColumns({c: F.lit("") for c in ("boundary", "admin_level", "country_code")})


def snapshot(places, refs):
    spark = places.sparkSession
    aliases = places.select("place_id", F.lit(0).alias("seq"), F.upper("name").alias("alias"))
    centers = places.filter("x IS NOT NULL AND place_id % 3 = 0").select(
        "place_id", F.lit("Geo/Test").alias("provider"), F.col("place_id").cast("string").alias("external_id"), F.lit(80).alias("priority"),
        F.lit(5).alias("score"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), "x", "y", "utm_zone", "lat", "lng",
    )
    polygons = places.filter("place_id % 2 = 0").select(
        "place_id", F.when(F.col("place_id") % 4 == 0, "Geo/Test").otherwise(rules.OSM).alias("provider"), F.lit("1").alias("external_id"),
        F.lit(90).alias("priority"), F.lit(0).alias("score"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.concat(F.lit("ring "), F.col("place_id") % 50).alias("ring_text"), F.lit(None).cast("string").alias("holes_text"),
        F.lit(32).alias("utm_zone"), F.lit("").alias("boundary"), F.lit("").alias("admin_level"), (F.col("place_id") % 8 == 0).alias("explicit_link"),
    )
    del spark
    return M.Snapshot(_bare(places), aliases, refs, centers, polygons)


def _merged(spark, d):
    held = snapshot(C.held(spark, d), C.held_refs(spark, d))
    new = snapshot(C.incoming(spark, d), C.incoming_refs(spark, d))
    return held, new


# new rows of one reference or OSM id become one place: components by least id
TARGETS = f"""{MATCHED}, un AS (SELECT k FROM i WHERE k NOT IN (SELECT k FROM ma)),
ed AS (SELECT a.k AS a, b.k AS b FROM i a JOIN i b ON a.osm > 0 AND a.osm = b.osm AND a.k <> b.k WHERE a.k IN (SELECT k FROM un) AND b.k IN (SELECT k FROM un)
 UNION SELECT a.k, b.k FROM ir a JOIN ir b ON a.k <> b.k AND a.pr = b.pr AND a.e = b.e AND a.f = b.f WHERE a.k IN (SELECT k FROM un) AND b.k IN (SELECT k FROM un)),
rc AS (SELECT k AS n, k AS l FROM un UNION SELECT ed.b, rc.l FROM rc JOIN ed ON ed.a = rc.n),
tg AS (SELECT k, hk AS t FROM ma UNION ALL SELECT n, -1 - min(l) FROM rc GROUP BY n)"""


@query(
    "merge_snapshots",
    f"""WITH RECURSIVE {TARGETS}, al2 AS (SELECT k AS t, k AS o, 0 AS turn, cls, osm FROM h UNION ALL SELECT t, tg.k, 1, cls, osm FROM tg JOIN i ON i.k = tg.k)
SELECT t AS place_id, arg_min(cls, (turn, o)) AS place, CAST(coalesce(arg_min(osm, (turn, o)) FILTER (osm > 0), 0) AS BIGINT) AS osm_id FROM al2 GROUP BY 1""",
)
def merge_snapshots(spark, d):
    held, new = _merged(spark, d)
    return M.merge_snapshots(held, new).places.select("place_id", "place", "osm_id")


@query(
    "merge_replacing",
    f"""WITH RECURSIVE {TARGETS}, hp AS (SELECT k AS t, CASE WHEN k % 4 = 0 THEN 'geo/test' ELSE 'osm' END AS pr, 'ring ' || (k % 50) AS rt FROM h WHERE k % 2 = 0),
ip AS (SELECT t, CASE WHEN tg.k % 4 = 0 THEN 'geo/test' ELSE 'osm' END AS pr, 'ring ' || (tg.k % 50) AS rt FROM tg WHERE tg.k % 2 = 0)
SELECT t AS place_id, pr AS provider, rt AS ring_text FROM hp WHERE pr <> 'geo/test' OR t NOT IN (SELECT t FROM tg) UNION SELECT t, pr, rt FROM ip""",
)
def merge_replacing(spark, d):
    held, new = _merged(spark, d)
    p = M.merge_replacing(held, new, ["geo/TEST"]).polygons
    return p.select("place_id", F.when(F.col("provider") == rules.OSM, "osm").otherwise(F.lower("provider")).alias("provider"), "ring_text")


@query(
    "copy_existing",
    f"""WITH {C.HELD}, {C.INC}, {C.OSMM}, pool AS (SELECT i.k, h.k AS hk, i.cls AS icls, {C.DIST} AS m FROM i JOIN h ON i.nk = h.nk AND i.cls = h.cls WHERE i.x IS NOT NULL AND h.x IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m, hk) AS rn FROM pool), al AS (SELECT k, hk, 1 AS stage FROM mo UNION ALL SELECT k, hk, 2 FROM rk WHERE rn = 1 AND m <= {C.LIMIT}),
ma AS (SELECT k, arg_min(hk, stage) AS hk FROM al GROUP BY 1)
SELECT k AS place_id, 'ring ' || (k % 50) AS ring_text FROM i WHERE k % 2 = 0 UNION SELECT k, 'ring ' || (hk % 50) FROM ma WHERE hk % 2 = 0""",
)
def copy_existing(spark, d):
    from geoloom.operators.matching import find_existing, place_names

    held, new = _merged(spark, d)
    m = find_existing(new.places, place_names(new.places), held.places, place_names(held.places))
    return M.copy_existing(new, held, m).polygons.select("place_id", "ring_text").distinct()


@query(
    "normalize_snapshot",
    """SELECT p_partkey AS place_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey > 0 THEN 2 ELSE 1 END AS refs, CASE WHEN p_partkey % 9 = 4 THEN 0 ELSE 1 END AS centers, 1 AS aliases FROM part""",
)
def normalize_snapshot(spark, d):
    """An OSM reference and a center candidate appear where they were missing."""
    held, _ = _merged(spark, d)
    refs = held.refs.withColumns({"provider": F.lit("Geo/Test")})
    n = M.normalize_snapshot(M.Snapshot(held.places, held.aliases, refs, held.centers, held.polygons), zone=32)
    count = lambda df, name: df.groupBy("place_id").agg(F.count(F.lit(1)).cast("int").alias(name))
    j = n.places.select("place_id").join(count(n.refs, "refs"), "place_id", "left").join(count(n.centers, "centers"), "place_id", "left")
    return j.join(count(n.aliases, "aliases"), "place_id", "left").na.fill(0)
