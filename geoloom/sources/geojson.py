"""GeoJSON documents to polygon rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import rings as G
from geoloom.functions.core import let
from geoloom.operators.utm import utm_zone, with_utm
from geoloom.sources.json_members import read_members, read_undivided

NESTED_T = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
DOCUMENT = (
    f"type string, coordinates string, geometries array<{NESTED_T}>, geometry {NESTED_T}, "
    f"features array<struct<type:string,geometry:{NESTED_T}>>"
)
RING_LIST = "array<array<array<double>>>"
CLOSING_TOLERANCE = 1e-7


def _flat(g: Column) -> Column:
    """A geometry and the members of its collection as one list."""
    own = F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates"))
    return F.concat(F.array(own), F.coalesce(g["geometries"], F.array().cast("array<struct<type:string,coordinates:string>>")))


def geometries(doc: Column) -> Column:
    """Every (type, coordinates) of a parsed document, collections opened."""
    none = F.array().cast("array<struct<type:string,coordinates:string>>")
    top = F.array(F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates")))
    inner = F.coalesce(F.flatten(F.transform(doc["geometries"], _flat)), none)
    single = F.when(doc["geometry"].isNotNull(), _flat(doc["geometry"])).otherwise(none)
    many = F.coalesce(
        F.flatten(F.transform(F.filter(doc["features"], lambda f: f["geometry"].isNotNull()), lambda f: _flat(f["geometry"]))),
        none,
    )
    return F.concat(top, inner, single, many)


def _clean(ring: Column) -> Column:
    """Pairs to vertices: bad pairs and the closing vertex go."""
    good = F.filter(
        ring,
        lambda p: (F.size(p) >= 2)
        & F.get(p, F.lit(1)).between(-80.0, 84.0)
        & F.get(p, F.lit(0)).between(-180.0, 180.0),
    )
    pts = F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))

    def open_ring(r: Column) -> Column:
        a, b = F.get(r, F.lit(0)), F.try_element_at(r, F.lit(-1))
        closed = (F.size(r) > 1) & (F.abs(a["x"] - b["x"]) <= CLOSING_TOLERANCE) & (F.abs(a["y"] - b["y"]) <= CLOSING_TOLERANCE)
        return F.when(closed, F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)

    return let(pts, open_ring)


def read_geojson(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One row per polygon: key, outer ring and holes in degrees
    (x is longitude). Polygons without a usable outer ring are left out."""
    doc = F.from_json(F.col(body), DOCUMENT)
    g = df.select(key, F.explode(geometries(doc)).alias("g")).filter(F.lower("g.type").isin("polygon", "multipolygon"))
    polygon = F.from_json("g.coordinates", RING_LIST)
    multi = F.from_json("g.coordinates", f"array<{RING_LIST}>")
    parts = F.when(F.lower("g.type") == "polygon", F.array(polygon)).otherwise(multi)
    one = g.select(key, F.explode(parts).alias("__rings"))
    cleaned = one.withColumn("__clean", F.transform("__rings", _clean))
    out = cleaned.select(
        key,
        F.get("__clean", F.lit(0)).alias("outer"),
        F.filter(F.slice("__clean", F.lit(2), F.greatest(F.size("__clean") - 1, F.lit(0))), lambda h: F.size(h) >= 3).alias("holes"),
    )
    return out.filter(F.size("outer") >= 3)


def read_geojson_files(spark: SparkSession, path: str) -> DataFrame:
    """file, id, outer, holes of the polygons in files of any size.

    Collections are read in byte ranges, one row per feature (with its id) or geometry. A bare
    geometry or feature is one row anyhow.
    """
    many = read_members(spark, path, "features", "geometries").select("file", "value")
    rows = many.unionByName(read_undivided(spark, path, many))
    rows = rows.select(F.struct("file", F.get_json_object("value", "$.id").alias("id")).alias("key"), "value")
    return read_geojson(rows, "key", "value").select("key.file", "key.id", "outer", "holes")


def project_rings(df: DataFrame, keep: list[str], outer: str = "outer", holes: str = "holes") -> DataFrame:
    """Rings in degrees to UTM metres, all in the zone of the first outer vertex.

    ``keep`` must identify a polygon row. Vertices are projected as rows and put
    back in their order by position.
    """
    rings = F.concat(F.array(F.col(outer)), F.coalesce(F.col(holes), F.array().cast(f"array<{G.RING}>")))
    first = F.get(outer, F.lit(0))
    d = df.select(*keep, utm_zone(first["x"]).alias("__zone"), F.posexplode(rings).alias("__ring", "__vs"))
    d = d.select(*keep, "__zone", "__ring", F.posexplode("__vs").alias("__seq", "__v"))
    d = d.withColumns({"__lng": F.col("__v.x"), "__lat": F.col("__v.y")}).drop("__v")
    # dealt by polygon once: its rings, then the polygon are gathered where they lie
    d = d.repartition(*[F.col(c) for c in keep])
    d = with_utm(d, F.col("__zone"), "__lat", "__lng", "x", "y", "utm_zone", "__band")
    ring = d.groupBy(*keep, "utm_zone", "__ring").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("__vs")
    )
    whole = ring.groupBy(*keep, "utm_zone").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__ring", "__vs"))), lambda r: r["__vs"]).alias("__rings")
    )
    return whole.select(
        *keep, "utm_zone", F.get("__rings", F.lit(0)).alias(outer),
        F.slice("__rings", F.lit(2), F.greatest(F.size("__rings") - 1, F.lit(0))).alias(holes),
    )
