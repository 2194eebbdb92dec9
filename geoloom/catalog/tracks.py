"""Routes, tracks and polylines over lineitem vertices and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import sql as S
from geoloom.operators import routes as R
from geoloom.registry import query
from geoloom.tables import table

SEQ = "(CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 100000 + l_suppkey"
RV = f"SELECT l_orderkey AS route_id, {SEQ} AS seq, {P.SQL_REGION.format(k='l_partkey')} FROM lineitem"
RO = "WINDOW o AS (PARTITION BY route_id ORDER BY seq)"
LEGS = f"""WITH v AS ({RV}), w AS (SELECT *, lag(lat) OVER o AS pla, lag(lng) OVER o AS pln FROM v {RO}),
 l AS (SELECT *, {S.hav('pla', 'pln', 'lat', 'lng', 6378.137)} AS km FROM w)"""


def vertices(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    seq = (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")
    v = li.select(F.col("l_orderkey").alias("route_id"), seq.alias("seq"), "l_partkey")
    return P.with_region(v, "l_partkey").drop("l_partkey")


# vertices of one route are split by line number, so no task holds a whole route
def bucket():
    return F.floor(F.col("seq") / 10000000000000)


@query(
    "leg_metrics",
    LEGS + f""" SELECT route_id, seq, round(km, 6) AS leg_km, round(fmod(degrees(atan2(sin(radians(lng - pln)) * cos(radians(lat)),
 cos(radians(pla)) * sin(radians(lat)) - sin(radians(pla)) * cos(radians(lat)) * cos(radians(lng - pln)))) + 360, 360), 4) AS leg_bearing FROM l""",
)
def leg_metrics(spark, d):
    m = R.leg_metrics(vertices(spark, d), bucket=bucket())
    return m.select("route_id", "seq", F.round("leg_km", 6).alias("leg_km"), F.round("leg_bearing", 4).alias("leg_bearing"))


@query("route_length_km", LEGS + " SELECT route_id, round(coalesce(sum(km), 0e0), 4) AS length_km FROM l GROUP BY 1")
def route_length_km(spark, d):
    return R.route_length_km(vertices(spark, d), bucket=bucket())


@query(
    "route_ends",
    f"WITH v AS ({RV}) SELECT route_id, arg_min(lat, seq) AS from_lat, arg_min(lng, seq) AS from_lng, arg_max(lat, seq) AS to_lat, arg_max(lng, seq) AS to_lng FROM v GROUP BY 1",
)
def route_ends(spark, d):
    return R.route_ends(vertices(spark, d))


ENC = """list_aggregate(list_transform(range(1, CAST(ceil(length(CASE WHEN {z} = 0 THEN '0' ELSE ltrim(bin({z}), '0') END) / 5.0) AS BIGINT) + 1),
 lambda i: chr(CAST((({z} >> ((i - 1) * 5)) & 31) + CASE WHEN i < CAST(ceil(length(CASE WHEN {z} = 0 THEN '0' ELSE ltrim(bin({z}), '0') END) / 5.0) AS BIGINT) THEN 32 ELSE 0 END + 63 AS INTEGER))), 'string_agg', '')"""
ENCODED = f"""WITH v AS ({RV}), s AS (SELECT route_id, seq, CAST(round_even(lat * 1e5, 0) AS BIGINT) AS la, CAST(round_even(lng * 1e5, 0) AS BIGINT) AS ln FROM v),
 d AS (SELECT route_id, seq, la - coalesce(lag(la) OVER o, 0) AS da, ln - coalesce(lag(ln) OVER o, 0) AS dn FROM s {RO}),
 z AS (SELECT route_id, seq, CASE WHEN da < 0 THEN -2 * da - 1 ELSE 2 * da END AS za, CASE WHEN dn < 0 THEN -2 * dn - 1 ELSE 2 * dn END AS zn FROM d),
 e AS (SELECT route_id, string_agg({ENC.format(z='za')} || {ENC.format(z='zn')}, '' ORDER BY seq) AS polyline FROM z GROUP BY 1)"""


@query("encode_polylines", ENCODED + " SELECT route_id, polyline FROM e")
def encode_polylines(spark, d):
    return R.encode_polylines(vertices(spark, d), bucket=bucket())


DECODED = f"""WITH v AS ({RV}) SELECT route_id, CAST(row_number() OVER o - 1 AS INTEGER) AS seq, round(lat, 5) AS lat, round(lng, 5) AS lng FROM v {RO}"""


@query("decode_polylines", DECODED)
def decode_polylines(spark, d):
    t = R.decode_polylines(R.encode_polylines(vertices(spark, d), bucket=bucket()))
    return t.select("route_id", "seq", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


@query(
    "event_gap_guard",
    """WITH e AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS)
  OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
SELECT event_id, coalesce(event_type = 'purchase' AND epoch_us(ts) - epoch_us(s) < 180000000, FALSE) AS refused FROM e""",
)
def event_gap_guard(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type").withColumn("g", F.col("user_id") % 7)
    g = R.event_gap_guard(
        ev, ["g"], F.col("event_type") == "signup", F.col("event_type") == "purchase", "ts", ["event_id"],
        bucket=F.date_trunc("day", "ts"),
    )
    return g.select("event_id", "refused")


@query(
    "track_legs",
    f"""WITH p AS ({P.sql_points('events', 'event_id', extra='event_id, user_id, ts')}), w AS (SELECT *, lag(lat) OVER o AS pla, lag(lng) OVER o AS pln, lag(ts) OVER o AS pts FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round({S.hav('pla', 'pln', 'lat', 'lng', 6378.137)}, 6) AS leg_km FROM w""",
)
def track_legs(spark, d):
    m = R.leg_metrics(P.event_points(spark, d), "user_id", ["ts", "event_id"], bucket=F.date_trunc("week", "ts"))
    return m.select("event_id", F.round("leg_km", 6).alias("leg_km"))


@query(
    "nearest_two_gap",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_extendedprice - 30000) AS dist, row_number() OVER o AS rn, lead(abs(l_extendedprice - 30000)) OVER o AS second FROM lineitem
 WINDOW o AS (PARTITION BY l_orderkey ORDER BY abs(l_extendedprice - 30000), l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_partkey, round(dist, 4) AS dist, round(second, 4) AS second_dist, round(second - dist, 2) AS gap FROM x WHERE rn = 1""",
)
def nearest_two_gap(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = li.withColumn("dist", F.abs(F.col("l_extendedprice") - 30000))
    n = R.nearest_two(li, ["l_orderkey"], "dist", ["l_linenumber", "l_partkey", "l_suppkey"])
    return n.select(
        "l_orderkey", "l_partkey", F.round("dist", 4).alias("dist"), F.round("second_dist", 4).alias("second_dist"),
        F.round(F.col("second_dist") - F.col("dist"), 2).alias("gap"),
    )
