"""Display areas over part squares, and batch runs of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import sql as S
from geoloom.catalog.tiles import AREA_SQL, areas
from geoloom.functions import rings as G
from geoloom.functions.rects import rect
from geoloom.operators import areas as A
from geoloom.registry import query
from geoloom.session import work_folder
from geoloom.streaming import jobs
from geoloom.tables import table

# degree squares of half side p_size * 2e-4 around each part's point
SQ = f"sq AS (SELECT p_partkey AS k, lng, lat, (1 + p_size % 50) * 2e-4 AS h FROM part JOIN ({P.sql_points('part', 'p_partkey', 'region', 'p_partkey AS kk')}) ON kk = p_partkey)"
MEET = "lng - h <= r_right AND lng + h >= r_left AND lat - h <= r_top AND lat + h >= r_bottom"


def rings(spark, d):
    p = P.with_region(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    h = (F.col("p_size") % 50 + 1) * F.lit(2e-4)
    k = F.col("p_partkey")
    return p.select(k.alias("place_id"), k.alias("ring_id"), G.square_ring(F.col("lng"), F.col("lat"), h).alias("path"), (k % 6 == 0).alias("linked"), "lat", "lng")


@query("path_intersects_bounds", f"WITH a AS ({AREA_SQL}), {SQ} SELECT k AS place_id, {MEET} AS meets FROM sq JOIN a ON n_nationkey = k % 25")
def path_intersects_bounds(spark, d):
    j = rings(spark, d).withColumn("n_nationkey", (F.col("place_id") % 25).cast("int")).join(areas(spark, d), "n_nationkey")
    return j.select("place_id", A.path_intersects_bounds("path", rect("r")).alias("meets"))


@query("paths_in_bounds", f"WITH a AS ({AREA_SQL}), {SQ} SELECT n_nationkey, k AS place_id FROM sq JOIN a ON {MEET}")
def paths_in_bounds(spark, d):
    return A.paths_in_bounds(rings(spark, d), areas(spark, d)).select("n_nationkey", "place_id")


@query(
    "geometry_for_area",
    f"""WITH a AS ({AREA_SQL}), {SQ}, t AS (SELECT n_nationkey, k FROM sq JOIN a ON k % 5 <> 0 AND {MEET}), i AS (SELECT n_nationkey, k FROM sq JOIN a ON lat BETWEEN r_bottom AND r_top AND lng BETWEEN r_left AND r_right)
SELECT n_nationkey, k AS place_id, 'ring' AS kind FROM t UNION ALL SELECT n_nationkey, k, 'center' FROM (SELECT * FROM i EXCEPT SELECT * FROM t) UNION ALL SELECT n_nationkey, k, 'center' FROM t WHERE k % 6 = 0""",
)
def geometry_for_area(spark, d):
    r = rings(spark, d)
    g = A.geometry_for_area(r.filter("place_id % 5 <> 0").drop("lat", "lng"), r.select("place_id", "lat", "lng"), areas(spark, d), "n_nationkey")
    return g.select("n_nationkey", "place_id", "kind")


# ---- the streaming transformations on the bounded table ----


@query(
    "stream_hit_counts",
    "SELECT date_trunc('hour', ts) AS window_start, event_type AS source, count(*) AS hits FROM events GROUP BY ALL",
)
def stream_hit_counts(spark, d):
    c = jobs.stream_hit_counts(table(spark, d, "events").withColumnRenamed("event_type", "source"))
    return c.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "source", "hits")


@query("stream_latest_request", "SELECT user_id AS view, max(event_id) AS generation, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1")
def stream_latest_request(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("view"), F.col("event_id").alias("generation"), F.col("event_type").alias("kind"))
    return jobs.stream_latest_request(ev)


@query(
    "stream_track_legs",
    f"""WITH p AS ({P.sql_points('events', 'event_id', extra='event_id, user_id, ts')}), w AS (SELECT *, lag(lat) OVER o AS pla, lag(lng) OVER o AS pln FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS session, round(lat, 6) AS lat, round(lng, 6) AS lng, round({S.hav('pla', 'pln', 'lat', 'lng', 6378.137)}, 6) AS leg_km FROM w""",
)
def stream_track_legs(spark, d):
    """The stream itself: the file is read as a source, legs go to a new folder."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    fixes = P.with_world(events, "event_id").withColumnRenamed("user_id", "session")
    out = work_folder(spark, "track-legs")
    legs = jobs.stream_track_legs(fixes)
    run = legs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state")
    run.trigger(availableNow=True).start(f"{out}/legs").awaitTermination()
    legs = spark.read.parquet(f"{out}/legs")
    return legs.select("session", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.round("leg_km", 6).alias("leg_km"))
