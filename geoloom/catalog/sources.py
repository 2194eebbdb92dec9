"""Readers over documents that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import sql as S
from geoloom.catalog.places import CLASS_SQL, part
from geoloom.functions import rings as G
from geoloom.registry import query
from geoloom.session import work_folder
from geoloom.sources import geojson, gpx, osm
from geoloom.tables import spread, table


def _closed(x, y, h):
    pts = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]
    return F.concat(F.lit("["), F.concat_ws(",", *[F.format_string("[%.4f,%.4f]", a, b) for a, b in pts]), F.lit("]"))


def geojson_docs(spark, d):
    p = P.with_region(spread(table(spark, d, "part").select("p_partkey")), "p_partkey")
    k, x, y = F.col("p_partkey"), F.col("lng"), F.col("lat")
    big, small = _closed(x, y, F.lit(0.02)), _closed(x, y, F.lit(0.005))
    poly = F.concat(F.lit('{"type":"Polygon","coordinates":['), big, F.lit(","), small, F.lit("]}"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), big, F.lit("],["), small, F.lit("]]}"))
    feature = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'), poly, F.lit('},{"type":"Feature","geometry":null}]}'))
    coll = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), poly, F.lit(","), multi, F.lit(',{"type":"Point","coordinates":[1,2]}]}'))
    return p.select("p_partkey", F.when(k % 4 == 0, poly).when(k % 4 == 1, multi).when(k % 4 == 2, feature).otherwise(coll).alias("body"))


@query(
    "read_geojson",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS polygons, CASE p_partkey % 4 WHEN 1 THEN 0 ELSE 1 END AS holes, CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 12 END AS vertices FROM part""",
)
def read_geojson(spark, d):
    g = geojson.read_geojson(geojson_docs(spark, d), "p_partkey")
    return g.groupBy("p_partkey").agg(
        F.count(F.lit(1)).alias("polygons"), F.sum(F.size("holes")).alias("holes"), F.sum(F.size("outer")).alias("vertices")
    )


@query(
    "project_rings",
    f"""WITH p AS (SELECT p_partkey, n, lng - e AS l0, lng + e AS l1, lat - e AS a0, lat + e AS a1 FROM ({P.sql_points('part', 'p_partkey', 'region', 'p_partkey')}), (VALUES (0, 0.02e0), (1, 0.02e0), (2, 0.005e0)) t(n, e)
 WHERE n = 0 OR p_partkey % 4 = 3 OR (p_partkey % 4 = 1 AND n = 2)),
c AS (SELECT p_partkey, n, CAST(floor((round(l0, 4) + 180) / 6) + 1 AS INTEGER) AS z, unnest([1, 2, 3, 4]) AS i, l0, l1, a0, a1 FROM p),
v AS (SELECT p_partkey, n, z, i, round(CASE WHEN i IN (1, 4) THEN l0 ELSE l1 END, 4) AS lng, round(CASE WHEN i IN (1, 2) THEN a0 ELSE a1 END, 4) AS lat FROM c), {S.utm_ctes('v', 'u', 'z')},
t AS (SELECT *, first_value(ex) OVER o AS ox, first_value(ny) OVER o AS oy FROM u WINDOW o AS (PARTITION BY p_partkey, n ORDER BY i)),
w AS (SELECT p_partkey, n, zone, ex, ny, ox, oy, coalesce(lead(ex) OVER o, ox) AS nx, coalesce(lead(ny) OVER o, oy) AS nyy FROM t WINDOW o AS (PARTITION BY p_partkey, n ORDER BY i))
SELECT p_partkey, utm_zone, area FROM (SELECT p_partkey, n, zone AS utm_zone, round(abs(sum((ex - ox) * (nyy - oy) - (nx - ox) * (ny - oy)) / 2), 0) AS area FROM w GROUP BY ALL)""",
)
def project_rings(spark, d):
    g = geojson.read_geojson(geojson_docs(spark, d), "p_partkey")
    # the polygons of a document differ in their rings
    g = g.withColumn("polygon", F.sha2(F.to_json(F.struct("outer", "holes")), 256))
    g = geojson.project_rings(g, ["p_partkey", "polygon"])
    return g.select("p_partkey", "utm_zone", F.round(G.ring_area("outer"), 0).alias("area"))


def osm_bodies(spark, d):
    """One answer per part: a place node, and a boundary relation of two open ways
    (the second one reversed) and one closed inner way."""
    p = P.with_region(spread(part(spark, d)), "p_partkey")
    k, x, y = F.col("p_partkey"), F.col("lng"), F.col("lat")
    base = (k + 1) * 20

    def node(i, dx, dy):
        return F.struct(
            F.lit("node").alias("type"), (base + i).alias("id"), (y + dy).alias("lat"), (x + dx).alias("lon"),
            F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>").alias("members"),
            F.lit(None).cast("map<string,string>").alias("tags"), F.lit(None).cast("struct<lat:double,lon:double>").alias("center"),
            F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("geometry"),
        )

    def other(kind, ident, nodes=None, members=None, tags=None, lat=None, lon=None, center=None, geometry=None):
        null = F.lit(None)
        return F.struct(
            F.lit(kind).alias("type"), ident.alias("id"), (null if lat is None else lat).cast("double").alias("lat"), (null if lon is None else lon).cast("double").alias("lon"),
            (null if nodes is None else nodes).cast("array<bigint>").alias("nodes"),
            (null if members is None else members).cast("array<struct<type:string,ref:bigint,role:string>>").alias("members"),
            (null if tags is None else tags).cast("map<string,string>").alias("tags"),
            (null if center is None else center).cast("struct<lat:double,lon:double>").alias("center"),
            (null if geometry is None else geometry).cast("array<struct<lat:double,lon:double>>").alias("geometry"),
        )

    def member(kind, ref, role):
        return F.struct(F.lit(kind).alias("type"), ref.alias("ref"), F.lit(role).alias("role"))

    h, s = 0.02, 0.005
    nodes = [node(1, -h, -h), node(2, h, -h), node(3, h, h), node(4, -h, h), node(5, -s, -s), node(6, s, -s), node(7, s, s), node(8, -s, s)]
    ways = [
        other("way", base + 1, nodes=F.array(base + 1, base + 2, base + 3)),
        other("way", base + 2, nodes=F.array(base + 1, base + 4, base + 99, base + 3)),
        other("way", base + 3, nodes=F.array(base + 5, base + 6, base + 7, base + 8, base + 5)),
    ]
    tags = F.create_map(
        F.lit("place"), F.col("place"), F.lit("name"), F.col("p_name"), F.lit("boundary"), F.lit("administrative"),
        F.lit("admin_level"), (F.col("p_size") % 4 + 8).cast("string"), F.lit("is_in:state"), F.col("p_brand"),
    )
    relation = other(
        "relation", k + 1,
        members=F.array(
            member("way", base + 1, "outer"), member("way", base + 2, ""), member("way", base + 3, "inner"),
            member("node", base + 9, "label"), member("node", base + 9, "admin_centre"), member("node", base + 10, "stop"),
        ),
        tags=tags, center=F.struct(y.alias("lat"), x.alias("lon")),
    )
    place_node = other("node", base + 9, tags=F.create_map(F.lit("place"), F.col("place"), F.lit("name"), F.col("p_name")), lat=y, lon=x)
    geo = F.array(*[F.struct((y + b).alias("lat"), (x + a).alias("lon")) for a, b in ((-s, -s), (s, -s), (s, s), (-s, s), (-s, -s))])
    estate = other("way", base + 12, tags=F.create_map(F.lit("landuse"), F.lit("residential"), F.lit("name"), F.col("p_name")), geometry=geo)
    elements = F.array(*nodes, *ways, relation, place_node, estate)
    return p.select("p_partkey", F.to_json(F.struct(elements.alias("elements"))).alias("body"))


def elements(spark, d):
    return osm.read_osm_elements(osm_bodies(spark, d))


@query("read_osm_elements", "SELECT t.type AS type, count(*) * t.n AS n FROM part, (VALUES ('node', 9), ('way', 4), ('relation', 1)) t(type, n) GROUP BY t.type, t.n")
def read_osm_elements(spark, d):
    return elements(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _lines(docs, head, inner, tail):
    """Lines of text, one document of up to a thousand keys after the other."""
    n = F.floor(F.col("k") / 1000)
    body = docs.select(n.alias("file"), F.lit(1).alias("line"), "k", F.concat(F.lit(","), inner).alias("value"))
    files = docs.select(n.alias("file")).distinct()
    ends = [files.select("file", F.lit(i).alias("line"), F.lit(0).alias("k"), F.lit(t).alias("value")) for i, t in ((0, head), (2, tail))]
    lines = body.unionByName(ends[0]).unionByName(ends[1])
    return lines.repartition("file").sortWithinPartitions("file", "line", "k").select("value")


OSM_HEAD = '{"version":0.6,"osm3s":{"copyright":"a } and a {","times":{"base":{}}},"elements":[{"type":"way","id":0,"tags":{"name":"\\"elements\\":[{"}}'
PARTS = f"""p AS (SELECT p_partkey, p_name, p_partkey * 20 + 20 AS b, lat, lng FROM part JOIN ({P.sql_points('part', 'p_partkey', 'region', 'p_partkey AS k')}) ON k = p_partkey)"""


@query(
    "read_osm_files",
    f"""WITH {PARTS}
SELECT 'node' AS type, b + t.i AS id, round(lat + t.dy, 6) AS lat, round(lng + t.dx, 6) AS lon, CASE WHEN t.i = 9 THEN p_name END AS name, CAST(NULL AS VARCHAR) AS refs, 0 AS vertices
 FROM p, (VALUES (1, -0.02e0, -0.02e0), (2, 0.02e0, -0.02e0), (3, 0.02e0, 0.02e0), (4, -0.02e0, 0.02e0), (5, -0.005e0, -0.005e0), (6, 0.005e0, -0.005e0), (7, 0.005e0, 0.005e0), (8, -0.005e0, 0.005e0), (9, 0e0, 0e0)) t(i, dx, dy)
UNION ALL SELECT 'way', b + 1, NULL, NULL, NULL, concat_ws(',', b + 1, b + 2, b + 3), 0 FROM p
UNION ALL SELECT 'way', b + 2, NULL, NULL, NULL, concat_ws(',', b + 1, b + 4, b + 99, b + 3), 0 FROM p
UNION ALL SELECT 'way', b + 3, NULL, NULL, NULL, concat_ws(',', b + 5, b + 6, b + 7, b + 8, b + 5), 0 FROM p
UNION ALL SELECT 'way', b + 12, NULL, NULL, p_name, NULL, 5 FROM p
UNION ALL SELECT 'relation', p_partkey + 1, NULL, NULL, p_name, concat('way:', b + 1, ':outer,way:', b + 2, ':,way:', b + 3, ':inner,node:', b + 9, ':label,node:', b + 9, ':admin_centre,node:', b + 10, ':stop'), 0 FROM p""",
)
def read_osm_files(spark, d):
    """Elements of all parts in a few long documents, written and read in byte ranges."""
    docs = osm_bodies(spark, d).withColumnRenamed("p_partkey", "k")
    path = work_folder(spark, "osm")
    inner = F.regexp_extract("body", r'(?s)^\{"elements":\[(.*)\]\}$', 1)
    _lines(docs, OSM_HEAD, inner, '],"after":[{"type":"node","id":-1}]}').write.text(path)
    e = osm.read_osm_files(spark, path).filter("id <> 0")
    member = F.transform("members", lambda m: F.concat_ws(":", m["type"], m["ref"], m["role"]))
    refs = F.coalesce(F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","), F.array_join(member, ","))
    return e.select(
        "type", "id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.col("tags")["name"].alias("name"),
        refs.alias("refs"), F.coalesce(F.size("geometry"), F.lit(0)).alias("vertices"),
    )


@query(
    "read_geojson_files",
    f"""WITH p AS (SELECT p_partkey, n, lng, lat, e FROM ({P.sql_points('part', 'p_partkey', 'region', 'p_partkey')}), (VALUES (0, 0.02e0), (1, 0.02e0), (2, 0.005e0)) t(n, e)
 WHERE n = 0 OR p_partkey % 4 = 3 OR (p_partkey % 4 = 1 AND n = 2))
SELECT CASE WHEN p_partkey % 4 < 3 THEN CAST(p_partkey AS VARCHAR) ELSE 'c' || p_partkey END AS id, round(lng - e, 4) AS x0, round(lat - e, 4) AS y0, round(lng + e, 4) AS x1, round(lat + e, 4) AS y1, 4 AS vertices,
 CASE WHEN p_partkey % 4 = 1 OR n > 0 THEN 0 ELSE 1 END AS holes FROM p""",
)
def read_geojson_files(spark, d):
    """All documents as features of a few collections, written and read in byte ranges."""
    docs = geojson_docs(spark, d).withColumnRenamed("p_partkey", "k")
    path = work_folder(spark, "geojson")
    part_of = F.get_json_object("body", "$.features[0].geometry")
    ident = F.concat(F.when(F.col("k") % 4 == 3, "c").otherwise(""), F.col("k").cast("string"))
    inner = F.concat(
        F.lit('{"type":"Feature","id":"'), ident, F.lit('","properties":{"note":"a } in a \\"text\\""},"geometry":'), F.coalesce(part_of, "body"), F.lit("}")
    )
    head = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"{"}},"features":[{"type":"Feature","geometry":null}'
    _lines(docs, head, inner, "]}").write.text(path)
    g = geojson.read_geojson_files(spark, path)
    least = lambda axis: F.array_min(F.transform("outer", lambda v: v[axis]))
    most = lambda axis: F.array_max(F.transform("outer", lambda v: v[axis]))
    return g.select(
        "id", least("x").alias("x0"), least("y").alias("y0"), most("x").alias("x1"), most("y").alias("y1"),
        F.size("outer").alias("vertices"), F.size("holes").alias("holes"),
    )


@query(
    "parse_places",
    f"""SELECT (p_partkey + 1) * 20 + 9 AS osm_id, 'node' AS osm_type, p_name AS name, {CLASS_SQL} AS place, '' AS region, round(lat, 6) AS lat FROM part JOIN ({P.sql_points('part', 'p_partkey', 'region', 'p_partkey AS k')}) ON k = p_partkey
UNION ALL SELECT p_partkey + 1, 'relation', p_name, {CLASS_SQL}, p_brand, round(lat, 6) FROM part JOIN ({P.sql_points('part', 'p_partkey', 'region', 'p_partkey AS k')}) ON k = p_partkey""",
)
def parse_places(spark, d):
    return osm.parse_places(elements(spark, d)).select("osm_id", "osm_type", "name", "place", "region", F.round("lat", 6).alias("lat"))


@query("parse_relation_candidates", f"SELECT p_partkey + 1 AS relation_id, p_name AS name, {CLASS_SQL} AS place, CAST(p_size % 4 + 8 AS VARCHAR) AS admin_level, p_brand AS region FROM part")
def parse_relation_candidates(spark, d):
    return osm.parse_relation_candidates(elements(spark, d)).select("relation_id", "name", "place", "admin_level", "region")


@query("relation_label_nodes", "SELECT p_partkey + 1 AS relation_id, (p_partkey + 1) * 20 + 9 AS node_id FROM part")
def relation_label_nodes(spark, d):
    return osm.relation_label_nodes(osm.parse_relation_candidates(elements(spark, d)))


@query("parse_residential", f"SELECT (p_partkey + 1) * 20 + 12 AS osm_id, p_name AS name, 4 AS vertices, round(lat, 6) AS lat FROM part JOIN ({P.sql_points('part', 'p_partkey', 'region', 'p_partkey AS k')}) ON k = p_partkey")
def parse_residential(spark, d):
    return osm.parse_residential(elements(spark, d)).select("osm_id", "name", F.size("ring").alias("vertices"), F.round("lat", 6).alias("lat"))


def way_vertices(spark, d):
    e = elements(spark, d)
    rel = osm.parse_relation_candidates(e)
    return osm.assemble_ways(rel, e.filter("type = 'way' AND nodes IS NOT NULL"), e.filter("type = 'node'"))


@query(
    "assemble_ways",
    "SELECT p_partkey + 1 AS relation_id, t.role AS role, t.member AS member, t.n AS vertices FROM part, (VALUES ('outer', 0, 3), ('outer', 1, 3), ('inner', 2, 5)) t(role, member, n)",
)
def assemble_ways(spark, d):
    return way_vertices(spark, d).groupBy("relation_id", "role", "member").agg(F.count(F.lit(1)).alias("vertices"))


def relation_rings(spark, d):
    v = way_vertices(spark, d).withColumnsRenamed({"lng": "x", "lat": "y"})
    return osm.assemble_rings(v)


@query(
    "assemble_rings",
    "SELECT p_partkey + 1 AS relation_id, t.role AS role, 4 AS vertices, t.a AS area FROM part, (VALUES ('outer', 0.0016e0), ('inner', 0.0001e0)) t(role, a)",
)
def assemble_rings(spark, d):
    r = relation_rings(spark, d)
    return r.select("relation_id", "role", F.size("ring").alias("vertices"), F.round(G.ring_area("ring"), 8).alias("area"))


@query("holes_to_outer", "SELECT p_partkey + 1 AS relation_id, 1 AS holes, 0.0015e0 AS area FROM part")
def holes_to_outer(spark, d):
    h = osm.holes_to_outer(relation_rings(spark, d))
    return h.select("relation_id", F.size("holes").alias("holes"), F.round(G.net_area("outer", "holes"), 8).alias("area"))


@query(
    "project_relation",
    f"SELECT p_partkey + 1 AS relation_id, CASE WHEN lng - 0.02e0 < 6 THEN 31 ELSE 32 END AS utm_zone, 4 AS vertices FROM ({P.sql_points('part', 'p_partkey', 'region', 'p_partkey')})",
)
def project_relation(spark, d):
    r = geojson.project_rings(osm.holes_to_outer(relation_rings(spark, d)), ["relation_id", "outer_no"])
    return r.select("relation_id", "utm_zone", F.size("outer").alias("vertices"))


def session_tracks(spark, d):
    return gpx.tracks(P.event_points(spark, d), "user_id", tie=("event_id",))


@query(
    "write_gpx_tracks",
    "SELECT CAST(user_id AS VARCHAR) AS name, date_trunc('day', ts) AS part, count(*) AS points FROM events GROUP BY ALL",
)
def write_gpx_tracks(spark, d):
    t = session_tracks(spark, d)
    return t.select("name", F.col("part").cast("timestamp_ntz").alias("part"), F.size(F.get("trkseg", F.lit(0))["trkpt"]).cast("bigint").alias("points"))


@query("read_gpx", f"WITH p AS ({P.sql_points('events', 'event_id', extra='user_id')}) SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS points, round(sum(lat), 4) AS lat_sum, round(sum(lng), 4) AS lng_sum FROM p GROUP BY 1")
def read_gpx(spark, d):
    p = gpx.parse_gpx(gpx.gpx_text(session_tracks(spark, d)), "name")
    return p.groupBy("name").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("lat").cast("double"), 4).alias("lat_sum"), F.round(F.sum("lng").cast("double"), 4).alias("lng_sum")
    )


@query(
    "write_read_gpx_files",
    f"""WITH p AS ({P.sql_points('events', 'event_id', extra='event_id, user_id, ts')})
SELECT CAST(user_id AS VARCHAR) AS name, ts, round(lat, 6) AS lat, round(lng, 6) AS lng, event_id % 5000 / 1e1 AS ele, event_id % 70 / 1e0 AS geoidheight, CASE event_id % 3 WHEN 0 THEN '3d' WHEN 1 THEN '2d' END AS fix,
 CAST(event_id % 12 AS VARCHAR) AS sat, CASE WHEN event_id % 4 <> 0 THEN event_id % 90 / 1e1 END AS hdop, event_id % 80 / 1e1 AS vdop, event_id % 60 / 1e1 AS pdop FROM p""",
)
def write_read_gpx_files(spark, d):
    """Every field of a fix through written files; absent ones stay absent."""
    k = F.col("event_id")
    tenths = lambda n: (k % n).cast("decimal(18,10)") / 10
    fixes = P.event_points(spark, d).withColumns(
        {"ele": tenths(5000), "geoidheight": (k % 70).cast("decimal(18,10)"), "fix": F.when(k % 3 == 0, "3d").when(k % 3 == 1, "2d"), "sat": (k % 12).cast("string"),
         "hdop": F.when(k % 4 != 0, tenths(90)), "vdop": tenths(80), "pdop": tenths(60)}
    )
    path = work_folder(spark, "gpx")
    gpx.write_gpx(fixes, path, "user_id", tie=("event_id",), optional=gpx.OPTIONAL)
    back = gpx.read_gpx(spark, path)
    number = [F.col(c).cast("double").alias(c) for c in ("ele", "geoidheight", "hdop", "vdop", "pdop")]
    return back.select("name", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("lat", "lng")], "fix", "sat", *number)
