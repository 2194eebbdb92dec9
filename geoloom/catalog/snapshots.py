"""Snapshots of five tables: stored, damaged, merged, and merged batch by batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom import points as P
from geoloom import rules
from geoloom.catalog import matching as C
from geoloom.catalog import merging as G
from geoloom.catalog import sql as S
from geoloom.catalog.places import CLASS_SQL, part
from geoloom.operators import merging as M
from geoloom.registry import query
from geoloom.session import work_folder
from geoloom.sources import snapshot as T
from geoloom.streaming import jobs
from geoloom.tables import table

#: What is shown of each table: two texts, a number, a position.
KINDS = {
    "places": ("name", "concat_ws('/', place, region, district)", "osm_id", "lat", "lng"),
    "aliases": ("alias", "NULL", "seq", "NULL", "NULL"),
    "refs": ("provider", "concat_ws('/', external_id, feature_type)", "seq", "NULL", "NULL"),
    # the id of a legacy center is its plane position, shown as lat and lng
    "centers": ("provider", f"CASE WHEN provider <> '{rules.LEGACY}' THEN external_id END", "priority", "lat", "lng"),
    "polygons": ("provider", "ring_text", "int(explicit_link)", "NULL", "NULL"),
}


def shown(s: M.Snapshot) -> DataFrame:
    """All rows of all five tables in common columns."""
    parts = [
        getattr(s, kind).selectExpr(f"'{kind}' AS kind", "place_id", f"string({a}) AS a", f"string({b}) AS b", f"bigint({n}) AS n", f"double({x}) AS lat", f"double({y}) AS lng")
        for kind, (a, b, n, x, y) in KINDS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


HELD_ROWS = f"""hx AS (SELECT h.k, p_name AS name, cls, rg, ds, osm, x IS NOT NULL AS has, lat, lng FROM h JOIN part ON p_partkey = h.k),
hrefs AS (SELECT p_partkey AS k, 0 AS seq, CASE WHEN p_partkey % 2 = 0 THEN '{rules.OSM}' ELSE 'Geo/Test' END AS pr, CAST(p_partkey % 700 AS VARCHAR) AS e, CASE WHEN p_partkey % 4 = 0 THEN 'node' ELSE 'way' END AS f FROM part)"""


@query(
    "write_read_snapshot",
    f"""WITH {C.HELD}, {HELD_ROWS}
SELECT 'places' AS kind, k AS place_id, name AS a, cls || '/' || rg || '/' || ds AS b, CAST(osm AS BIGINT) AS n, CASE WHEN has THEN lat END AS lat, CASE WHEN has THEN lng END AS lng FROM hx
UNION ALL SELECT 'aliases', k, upper(name), NULL, 0, NULL, NULL FROM hx
UNION ALL SELECT 'refs', k, pr, e || '/' || f, seq, NULL, NULL FROM hrefs
UNION ALL SELECT 'centers', k, 'Geo/Test', CAST(k AS VARCHAR), 80, lat, lng FROM hx WHERE has AND k % 3 = 0
UNION ALL SELECT 'polygons', k, CASE WHEN k % 4 = 0 THEN 'Geo/Test' ELSE '{rules.OSM}' END, 'ring ' || (k % 50), (k % 8 = 0)::INT, NULL, NULL FROM hx WHERE k % 2 = 0""",
)
def write_read_snapshot(spark, d):
    """The held snapshot is stored, then the incoming one, whose files are then damaged: the held one is read."""
    held, new = G._merged(spark, d)
    root = work_folder(spark, "snapshot")
    T.write_snapshot(held, root)
    version = T.write_snapshot(new, root)
    fs, path, hadoop = T._fs(spark, f"{root}/{version}/refs")
    for f in fs.listStatus(path):
        if f.getPath().getName().endswith(".parquet"):
            fs.delete(f.getPath(), False)
    return shown(T.read_snapshot(spark, root))


@query(
    "merge_snapshots_tables",
    f"""WITH RECURSIVE {G.TARGETS}, {HELD_ROWS},
ix AS (SELECT t, i.k, CASE WHEN i.k % 8 = 7 THEN upper(p_name) ELSE p_name END AS name, cls, rg, ds, osm, x IS NOT NULL AS has, lat, lng FROM tg JOIN i ON i.k = tg.k JOIN part ON p_partkey = pk),
pl AS (SELECT k AS t, k AS o, 0 AS turn, name, cls, rg, ds, osm, has, lat, lng FROM hx UNION ALL SELECT t, k, 1, name, cls, rg, ds, osm, has, lat, lng FROM ix),
all_names AS (SELECT k AS t, 0 AS turn, 0 AS seq, upper(name) AS alias FROM hx UNION ALL SELECT k, 0, 1000000, name FROM hx UNION ALL SELECT t, 1, 0, upper(name) FROM ix UNION ALL SELECT t, 1, 2000000, name FROM ix),
irefs AS (SELECT c_custkey AS k, 0 AS seq, upper('{rules.OSM}') AS pr, CAST(c_custkey % 900 AS VARCHAR) AS e FROM customer UNION ALL SELECT c_custkey, 1, 'geo/test', CAST(c_custkey * 3 % 900 AS VARCHAR) FROM customer),
re AS (SELECT k AS t, 0 AS turn, seq, pr, e, f FROM hrefs UNION ALL SELECT t, 1, seq, pr, e, 'NODE' FROM irefs JOIN tg USING (k)),
ce AS (SELECT k AS t, 0 AS turn, CAST(k AS VARCHAR) AS e, lat, lng FROM hx WHERE has AND k % 3 = 0 UNION ALL SELECT t, 1, CAST(k AS VARCHAR), lat, lng FROM ix WHERE has AND k % 3 = 0),
po AS (SELECT k AS t, k FROM hx WHERE k % 2 = 0 UNION ALL SELECT t, k FROM ix WHERE k % 2 = 0)
SELECT 'places' AS kind, t AS place_id, arg_min(name, (turn, o)) AS a, arg_min(cls, (turn, o)) || '/' || arg_min(rg, (turn, o)) || '/' || coalesce(arg_min(ds, (turn, o)) FILTER (ds <> ''), '') AS b,
  CAST(coalesce(arg_min(osm, (turn, o)) FILTER (osm > 0), 0) AS BIGINT) AS n, arg_min(lat, (turn, o)) FILTER (has) AS lat, arg_min(lng, (turn, o)) FILTER (has) AS lng FROM pl GROUP BY t
UNION ALL SELECT 'aliases', t, arg_min(alias, (turn, seq, alias)), NULL, arg_min(seq, (turn, seq, alias)), NULL, NULL FROM all_names GROUP BY t, lower(alias)
UNION ALL SELECT 'refs', t, arg_min(pr, (turn, seq)), arg_min(e || '/' || f, (turn, seq)), arg_min(seq, (turn, seq)), NULL, NULL FROM re GROUP BY t, lower(pr), e, lower(f)
UNION ALL SELECT 'centers', t, 'Geo/Test', e, 80, arg_max(lat, turn), arg_max(lng, turn) FROM ce GROUP BY t, e
UNION ALL (SELECT DISTINCT 'centers', t, '{rules.LEGACY}', NULL, {rules.LEGACY_PRIORITY}, lat, lng FROM ix WHERE has AND k % 3 <> 0)
UNION ALL SELECT 'polygons', t, CASE WHEN k % 4 = 0 THEN 'Geo/Test' ELSE '{rules.OSM}' END, 'ring ' || (k % 50), max((k % 8 = 0)::INT), NULL, NULL FROM po GROUP BY 2, 3, 4""",
)
def merge_snapshots_tables(spark, d):
    """All five tables of a merge, stored and read back."""
    held, new = G._merged(spark, d)
    root = work_folder(spark, "merged")
    T.write_snapshot(M.merge_snapshots(held, new), root)
    return shown(T.read_snapshot(spark, root, deep=True))


# ---- partial snapshots as a stream ----


def order_documents(spark, d):
    """Orders as documents of the places they name by reference, each with an alias, a center and a ring of its own."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = part(spark, d).select(F.col("p_partkey").alias("pk"), "p_name", "place")
    o = o.withColumn("pk", F.col("o_custkey") % p.count() + 1).join(p, "pk")
    k = F.col("o_orderkey")
    point = {c: F.lit(None).cast("int" if c == "utm_zone" else "double") for c in ("x", "y", "utm_zone", "lat", "lng")}
    texts = {c: F.lit("") for c in M.TEXTS} | {"name": F.col("p_name"), "place": F.col("place"), "district": F.concat(F.lit("d"), F.col("pk") % 5)}
    at = (F.lit(50.0) + k % 1000 / 1000, F.lit(6.5) + k % 777 / 1000)
    center = {"provider": F.lit("Orders"), "external_id": k.cast("string"), "priority": F.lit(70), "score": F.lit(3), "updated_at": F.lit(None).cast("timestamp_ntz")}
    center |= {"x": F.lit(1.0) * k, "y": F.lit(2.0) * k, "utm_zone": F.lit(32), "lat": at[0], "lng": at[1]}
    ring = {"provider": F.concat(F.lit("P"), k % 2), "external_id": F.lit("1"), "priority": F.lit(90), "score": F.lit(0), "updated_at": F.lit(None).cast("timestamp_ntz")}
    ring |= {"ring_text": F.concat(F.lit("ring "), k % 7), "holes_text": F.lit(None).cast("string"), "utm_zone": F.lit(32), "boundary": F.lit(""), "admin_level": F.lit(""), "explicit_link": k % 8 == 0}
    pack = lambda cols: F.struct(*[c.alias(n) for n, c in cols.items()])
    return o.select(
        k.alias("place_id"), *[c.alias(n) for n, c in texts.items()], F.lit("").alias("osm_type"), F.lit(0).cast("bigint").alias("osm_id"), *[c.alias(n) for n, c in point.items()],
        F.array(pack({"seq": F.lit(0), "alias": F.col("o_orderpriority")})).alias("aliases"),
        F.array(
            pack({"seq": F.lit(0), "provider": F.lit("Parts"), "external_id": F.col("pk").cast("string"), "feature_type": F.lit("node")}),
            pack({"seq": F.lit(1), "provider": F.lit("Orders"), "external_id": k.cast("string"), "feature_type": F.lit("node")}),
        ).alias("refs"),
        F.array(pack(center)).alias("centers"), F.array(pack(ring)).alias("polygons"),
    )


def part_snapshot(spark, d):
    """Every part as a place with one reference; no district, so the first document fills it."""
    p = P.with_region(part(spark, d), "p_partkey")
    k = F.col("p_partkey")
    texts = {c: F.lit("") for c in M.TEXTS} | {"name": F.col("p_name"), "place": F.col("place")}
    places = p.select(
        k.alias("place_id"), *[c.alias(n) for n, c in texts.items()], F.lit("").alias("osm_type"), F.lit(0).cast("bigint").alias("osm_id"),
        (F.col("lng") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"), F.lit(32).alias("utm_zone"), "lat", "lng",
    )
    refs = p.select(k.alias("place_id"), F.lit(0).alias("seq"), F.lit("Parts").alias("provider"), k.cast("string").alias("external_id"), F.lit("node").alias("feature_type"))
    empty = T.from_documents(order_documents(spark, d).limit(0))
    return M.Snapshot(places, empty.aliases, refs, empty.centers, empty.polygons)


@query(
    "stream_merge_snapshots",
    f"""WITH p AS (SELECT p_partkey AS k, p_name AS name, {CLASS_SQL} AS cls, {P.SQL_REGION.format(k='p_partkey')} FROM part),
o AS (SELECT o_custkey % (SELECT count(*) FROM part) + 1 AS t, o_orderkey AS k, o_orderpriority AS alias FROM orders)
SELECT 'places' AS kind, k AS place_id, name AS a, cls || '//' || CASE WHEN k IN (SELECT t FROM o) THEN 'd' || (k % 5) ELSE '' END AS b, 0::BIGINT AS n, lat, lng FROM p
UNION ALL SELECT 'aliases', k, name, NULL, 1000000, NULL, NULL FROM p UNION ALL (SELECT DISTINCT 'aliases', t, alias, NULL, 0, NULL, NULL FROM o)
UNION ALL SELECT 'refs', k, 'Parts', k || '/node', 0, NULL, NULL FROM p UNION ALL SELECT 'refs', t, 'Orders', k || '/node', 1, NULL, NULL FROM o
UNION ALL SELECT 'centers', t, 'Orders', CAST(k AS VARCHAR), 70, 50e0 + k % 1000 / 1e3, 6.5e0 + k % 777 / 1e3 FROM o
UNION ALL SELECT 'polygons', t, 'P' || (k % 2), 'ring ' || (k % 7), max((k % 8 = 0)::INT), NULL, NULL FROM o GROUP BY 2, 3, 4""",
)
def stream_merge_snapshots(spark, d):
    """Documents arrive in three files, one batch each."""
    root, feed, state = work_folder(spark, "held"), work_folder(spark, "feed"), work_folder(spark, "state")
    T.write_snapshot(part_snapshot(spark, d), root)
    docs = order_documents(spark, d)
    for i in range(3):
        docs.filter(F.col("place_id") % 3 == i).coalesce(1).write.mode("append").parquet(feed)
    parts = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    jobs.stream_into_snapshot(parts, root, state).trigger(availableNow=True).start().awaitTermination()
    return shown(T.read_snapshot(spark, root))


LATENESS_DAYS = 3
IDLE_HOURS = 36


@query(
    "stream_legs_in_order",
    f"""WITH p AS ({P.sql_points('events', 'event_id', extra='event_id, user_id, ts')}), w AS (SELECT *, lag(lat) OVER o AS pla, lag(lng) OVER o AS pln, lag(ts) OVER o AS pts FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, lat, lng, CASE WHEN ts - pts <= INTERVAL {IDLE_HOURS} HOUR THEN pla END AS pla, CASE WHEN ts - pts <= INTERVAL {IDLE_HOURS} HOUR THEN pln END AS pln FROM w)
SELECT user_id AS session, ts, round(lat, 6) AS lat, round(lng, 6) AS lng, round({S.hav('pla', 'pln', 'lat', 'lng', 6378.137)}, 6) AS leg_km FROM g
WHERE epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - {LATENESS_DAYS} * 86400000000::BIGINT""",
)
def stream_legs_in_order(spark, d):
    """Events arrive in files whose times overlap by up to 44 hours; legs come out in order."""
    ev = table(spark, d, "events").select("event_id", "user_id", "ts")
    moved = F.col("ts") + F.make_interval(days=F.lit(0), hours=F.pmod(F.xxhash64("event_id"), F.lit(44)).cast("int"))
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    edges = [lo + (hi - lo) * f for f in (0.3, 0.6)]
    place = F.when(moved < F.lit(edges[0]), 0).when(moved < F.lit(edges[1]), 1).otherwise(2)
    feed, out = work_folder(spark, "feed"), work_folder(spark, "legs")
    for i in range(3):
        ev.filter(place == i).coalesce(1).write.mode("append").parquet(feed)
    events = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    fixes = P.with_world(events, "event_id").withColumnRenamed("user_id", "session")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    jobs.rocksdb_state(spark)
    try:
        legs = jobs.stream_legs_in_order(fixes, f"{LATENESS_DAYS} days", IDLE_HOURS * 3_600_000)
        run = legs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state")
        run.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    finally:
        spark.conf.set(key, before)
    legs = spark.read.parquet(f"{out}/rows")
    return legs.select("session", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.round("leg_km", 6).alias("leg_km"))
