"""Tile-store jobs over the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import sql as S
from geoloom.operators import summaries as Y
from geoloom.operators import tile_store as T
from geoloom.operators.tiling import with_tile
from geoloom.registry import query
from geoloom.session import work_folder
from geoloom.tables import table

ST = f"""WITH p AS ({P.sql_points('orders', 'o_orderkey', extra='o_orderkey AS id, o_custkey, o_orderdate')}),
s AS (SELECT id, CAST(o_custkey % 3 AS INTEGER) AS type, 8 AS zoom, {S.merc_tile('lat', 'lng', 8)[0]} AS x, {S.merc_tile('lat', 'lng', 8)[1]} AS y,
 CASE WHEN id % 50 = 7 THEN NULL ELSE o_orderdate END AS cached_at, 1000 + id % 5000 AS bytes FROM p)"""


def store(spark, d):
    t = with_tile(P.order_points(spark, d), 8, x="x", y="y")
    k = F.col("o_orderkey")
    return t.select(
        k.alias("id"), (F.col("o_custkey") % 3).cast("int").alias("type"), F.lit(8).alias("zoom"), "x", "y",
        F.when(k % 50 != 7, F.col("o_orderdate")).alias("cached_at"), (k % 5000 + 1000).alias("bytes"),
        F.format_string("tile-%d", k).cast("binary").alias("tile"),
    )


@query(
    "export_new_tiles",
    ST + " SELECT id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.id % 4 = 0 AND b.x = a.x AND b.y = a.y AND b.zoom = a.zoom AND b.type = a.type)",
)
def export_new_tiles(spark, d):
    s = store(spark, d)
    return T.export_new_tiles(s, s.filter("id % 4 = 0")).select("id")


@query(
    "tiles_missing",
    ST + f""", p2 AS ({P.sql_points('customer', 'c_custkey', extra='c_custkey')}), c AS (SELECT DISTINCT 8 AS zoom, {S.merc_tile('lat', 'lng', 8)[0]} AS x, {S.merc_tile('lat', 'lng', 8)[1]} AS y FROM p2)
SELECT zoom, x, y FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id % 2 = 1 AND s.x = c.x AND s.y = c.y)""",
)
def tiles_missing(spark, d):
    c = P.with_world(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    plan = with_tile(c, 8, x="x", y="y").select(F.lit(8).alias("zoom"), "x", "y").distinct()
    return T.tiles_missing(plan, store(spark, d).filter("id % 2 = 1"))


@query("expire_rows", ST + " SELECT id FROM s WHERE NOT coalesce(cached_at < TIMESTAMP '1998-01-01' AND type = 1, FALSE)")
def expire_rows(spark, d):
    return T.expire_rows(store(spark, d), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), 1).select("id")


@query("expire_rows_any_type", ST + " SELECT id FROM s WHERE NOT coalesce(cached_at < TIMESTAMP '1998-01-01', FALSE)")
def expire_rows_any_type(spark, d):
    return T.expire_rows(store(spark, d), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))).select("id")


@query(
    "lookup_tiles",
    ST + """, q AS (SELECT id AS rid, type, zoom, x, y FROM s), h AS (SELECT 0 AS rank, 'memory' AS source, * FROM s WHERE id % 5 = 0 UNION ALL SELECT 1, 'primary', * FROM s WHERE id % 3 = 0 UNION ALL SELECT 2, 'secondary', * FROM s WHERE id % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY type, zoom, x, y ORDER BY rank, cached_at NULLS FIRST, id) AS rn FROM h)
SELECT rid, source FROM q LEFT JOIN b ON rn = 1 AND q.type = b.type AND q.zoom = b.zoom AND q.x = b.x AND q.y = b.y""",
)
def lookup_tiles(spark, d):
    s = store(spark, d)
    q = s.select(F.col("id").alias("rid"), "type", "zoom", "x", "y")
    stores = [("memory", s.filter("id % 5 = 0")), ("primary", s.filter("id % 3 = 0")), ("secondary", s.filter("id % 2 = 0"))]
    return T.lookup_tiles(q, stores).select("rid", "source")


@query("hit_source_counts", ST + """, h AS (SELECT CASE WHEN id % 5 = 0 THEN 'memory' WHEN id % 3 = 0 THEN 'store' ELSE 'network' END AS source FROM s) SELECT source, count(*) AS hits FROM h GROUP BY 1""")
def hit_source_counts(spark, d):
    k = F.col("id")
    s = store(spark, d).withColumn("source", F.when(k % 5 == 0, "memory").when(k % 3 == 0, "store").otherwise("network"))
    return Y.hit_source_counts(s)


@query("union_stores", ST + " SELECT type, zoom, x, y FROM s WHERE id % 3 <> 1 UNION SELECT type, zoom, x, y FROM s WHERE id % 3 <> 2")
def union_stores(spark, d):
    s = store(spark, d).select("id", "type", "zoom", "x", "y")
    return T.union_stores(s.filter("id % 3 <> 1").drop("id"), s.filter("id % 3 <> 2").drop("id"))


@query("tile_count", ST + " SELECT count(*) AS tiles FROM s")
def tile_count(spark, d):
    return T.tile_count(store(spark, d))


@query("zoom_extent", "SELECT CAST(min(5 + o_orderkey % 9) AS INTEGER) AS min_zoom, CAST(max(5 + o_orderkey % 9) AS INTEGER) AS max_zoom FROM orders")
def zoom_extent(spark, d):
    return T.zoom_extent(table(spark, d, "orders").select((F.col("o_orderkey") % 9 + 5).cast("int").alias("zoom")))


@query("store_size", "SELECT CAST(sum(length('tile-' || o_orderkey)) AS BIGINT) AS bytes FROM orders")
def store_size(spark, d):
    return T.store_size(store(spark, d))


@query(
    "evict_oldest",
    ST + ", r AS (SELECT id, sum(bytes) OVER (ORDER BY cached_at DESC NULLS LAST, id DESC ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT id FROM r WHERE run <= 20000000",
)
def evict_oldest(spark, d):
    by_id = F.floor(F.col("id") / 4096)
    return T.evict_oldest(store(spark, d), 20_000_000, bucket=F.date_trunc("month", "cached_at"), finer=[F.col("cached_at"), by_id]).select("id")


@query("read_mbtiles", ST + " SELECT id, zoom, x, 255 - ((y * 7) % 256) AS y FROM s")
def read_mbtiles(spark, d):
    s = store(spark, d).select("id", F.col("zoom").alias("zoom_level"), F.col("x").alias("tile_column"), (F.col("y") * 7 % 256).alias("tile_row"))
    return T.read_mbtiles(s).select("id", "zoom", "x", "y")


@query("mbtiles_metadata", "SELECT n_regionkey, max(CASE WHEN n_nationkey % 5 = 0 THEN n_name END) AS name, max(CASE WHEN n_nationkey % 5 = 1 THEN n_name END) AS format, max(CASE WHEN n_nationkey % 5 = 2 THEN n_name END) AS bounds FROM nation GROUP BY 1")
def mbtiles_metadata(spark, d):
    """Several packages at once: each region's nations stand for name/value pairs."""
    n = table(spark, d, "nation")
    names = F.array(*[F.lit(v) for v in ("name", "format", "bounds", "x", "y")])
    pairs = n.groupBy("n_regionkey", F.element_at(names, F.col("n_nationkey") % 5 + 1).alias("name")).agg(F.max("n_name").alias("value"))
    return T.mbtiles_metadata(pairs, ("name", "format", "bounds"), ["n_regionkey"])


@query("write_read_tile_store", ST + " SELECT id, type, zoom + id % 3 AS zoom, x, y, cached_at, 'tile-' || id AS tile FROM s WHERE NOT coalesce(cached_at < TIMESTAMP '1995-01-01' AND type = 2, FALSE)")
def write_read_tile_store(spark, d):
    """A store in zoom folders, rewritten without its expired rows and read back."""
    path, kept = work_folder(spark, "tiles"), work_folder(spark, "kept")
    T.write_tile_store(store(spark, d).drop("bytes").withColumn("zoom", (F.col("zoom") + F.col("id") % 3).cast("int")), path)
    T.rewrite_without_expired(spark, path, kept, F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")), 2)
    back = T.read_tile_store(spark, kept)
    return back.select("id", "type", "zoom", "x", "y", "cached_at", F.col("tile").cast("string").alias("tile"))


@query("write_read_joined_store", ST + " SELECT id, type, zoom, x, y, CASE WHEN id % 11 <> 3 THEN 'tile-' || id END AS tile FROM s")
def write_read_joined_store(spark, d):
    """Headers and blobs in two tables, written in two appends; a header without a blob keeps none."""
    path, blobs = work_folder(spark, "headers"), work_folder(spark, "blobs")
    s = store(spark, d).withColumn("tile", F.when(F.col("id") % 11 != 3, F.col("tile")))
    for part in (0, 1):
        T.write_joined_store(s.filter(F.col("id") % 2 == part), path, blobs)
    back = T.read_tile_store(spark, path, joined=True, tile_path=blobs)
    return back.select("id", "type", "zoom", "x", "y", F.col("tile").cast("string").alias("tile"))
