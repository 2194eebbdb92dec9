"""GPX files: track points in, session tracks out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names of GPX 1.1
NAMESPACE = "http://www.topografix.com/GPX/1/1"
POINT = (
    "struct<_lat:decimal(18,10),_lon:decimal(18,10),time:timestamp,ele:decimal(18,10),geoidheight:decimal(18,10),"
    "fix:string,sat:string,hdop:decimal(18,10),vdop:decimal(18,10),pdop:decimal(18,10)>"
)
OPTIONAL = ("ele", "geoidheight", "fix", "sat", "hdop", "vdop", "pdop")
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """One row per track point: track name, segment and position in it."""
    t = (
        spark.read.format("xml").option("rowTag", "trk").option("ignoreNamespace", "true")
        .schema(f"name string, trkseg array<struct<trkpt:array<{POINT}>>>").load(path)
    )
    s = t.select("name", F.posexplode("trkseg").alias("segment", "s"))
    p = s.select("name", "segment", F.posexplode("s.trkpt").alias("seq", "p"))
    return p.select(
        "name", "segment", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lng"), F.col("p.time").alias("ts"),
        *[F.col(f"p.{c}").alias(c) for c in OPTIONAL],
    )


def parse_gpx(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """GPX texts of a table to track points."""
    doc = F.from_xml(
        F.col(body), f"trk array<struct<name:string,trkseg:array<struct<trkpt:array<{POINT}>>>>>", {"ignoreNamespace": "true"}
    )
    t = df.select(key, F.posexplode(doc["trk"]).alias("track", "t"))
    s = t.select(key, "track", F.posexplode("t.trkseg").alias("segment", "s"))
    p = s.select(key, "track", "segment", F.posexplode("s.trkpt").alias("seq", "p"))
    return p.select(key, "track", "segment", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lng"), F.col("p.time").alias("ts"))


def tracks(
    df: DataFrame, session: str, ts: str = "ts", lat: str = "lat", lng: str = "lng", tie: tuple[str, ...] = (),
    bucket: Column | None = None, optional: tuple[str, ...] = (),
) -> DataFrame:
    """Fixes to nested tracks: one track row per session and bucket, so that no
    row holds more of a very long session than one bucket (a day by default)."""
    b = F.date_trunc("day", F.col(ts)) if bucket is None else bucket
    # the order of the format: elevation, time, the rest
    first, rest = [c for c in optional if c == "ele"], [c for c in OPTIONAL if c in optional and c != "ele"]
    if len(first) + len(rest) != len(optional):
        raise ValueError(f"optional fields are among {OPTIONAL}")
    at = F.struct(
        F.col(lat).cast("decimal(18,10)").alias("_lat"), F.col(lng).cast("decimal(18,10)").alias("_lon"),
        *[F.col(c) for c in first], F.col(ts).cast("timestamp").alias("time"), *[F.col(c) for c in rest],
    )
    order = F.struct(F.col(ts).alias("o0"), *[F.col(c).alias(f"o{i + 1}") for i, c in enumerate(tie)], at.alias("pt"))
    g = df.groupBy(F.col(session).cast("string").alias("name"), b.alias("part")).agg(F.array_sort(F.collect_list(order)).alias("pts"))
    seg = F.array(F.struct(F.transform("pts", lambda p: p["pt"]).alias("trkpt")))
    return g.select("name", "part", seg.alias("trkseg"))


def write_gpx(df: DataFrame, path: str, session: str, mode: str = "overwrite", **kw) -> None:
    """Write sessions as GPX: one file per task, a ``trk`` per session and day."""
    t = tracks(df, session, **kw).repartitionByRange("name", "part").sortWithinPartitions("name", "part").drop("part")
    t.write.format("xml").option("rootTag", f'gpx version="1.1" creator="geoloom" xmlns="{NAMESPACE}"').option(
        "rowTag", "trk"
    ).option("timestampFormat", TIME_FORMAT).mode(mode).save(path)


def gpx_text(trk: DataFrame) -> DataFrame:
    """Track rows as GPX texts, for response tables."""
    body = F.to_xml(F.struct("name", "trkseg"), {"rowTag": "trk", "timestampFormat": TIME_FORMAT})
    head = F.lit(f'<gpx version="1.1" xmlns="{NAMESPACE}">')
    return trk.select("name", "part", F.concat(head, body, F.lit("</gpx>")).alias("body"))
