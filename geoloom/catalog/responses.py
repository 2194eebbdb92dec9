"""Response parsing; the bodies are derived from the tables by Spark first."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import sql as S
from geoloom.catalog.tracks import DECODED, RV, bucket, vertices
from geoloom.operators import routes as R
from geoloom.functions.core import beside_one_row
from geoloom.registry import query
from geoloom.sources import responses as X
from geoloom.tables import table

ROWS_PER_TASK = 50_000


def _obj(**fields) -> F.Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def route_responses(spark, d):
    """One answer per order, its format picked by the key."""
    e = R.encode_polylines(vertices(spark, d), bucket=bucket())
    k, line = F.col("route_id"), F.col("polyline")
    osrm = _obj(routes=F.array(F.struct((k % 1000 + F.lit(0.5)).alias("duration"), line.alias("geometry"))))
    hopper = _obj(
        paths=F.array(
            F.struct(
                (k * 1000).alias("time"), line.alias("points"),
                F.array(F.struct(F.lit("start").alias("text")), F.struct(F.lit("end").alias("text"))).alias("instructions"),
            )
        )
    )
    google = F.when(
        k % 12 == 2,
        _obj(error=F.struct(F.lit(403).alias("code"), F.lit("no key").alias("message"), F.lit("REQUEST_DENIED").alias("status"))),
    ).otherwise(
        _obj(
            status=F.lit("OK"),
            routes=F.array(
                F.struct(
                    F.concat(F.lit("A"), k % 90).alias("summary"),
                    F.struct(line.alias("points")).alias("overview_polyline"),
                    F.array(F.struct(F.struct(F.concat(k % 60, F.lit(" min")).alias("text")).alias("duration"))).alias("legs"),
                )
            ),
        )
    )
    return e.select(
        "route_id",
        F.element_at(F.array(F.lit("osrm"), F.lit("graphhopper"), F.lit("google")), (k % 3 + 1).cast("int")).alias("format"),
        F.when(k % 3 == 0, osrm).when(k % 3 == 1, hopper).otherwise(google).alias("body"),
    )


@query("parse_route_responses", f"SELECT * FROM ({DECODED}) WHERE route_id % 12 <> 2")
def parse_route_responses(spark, d):
    _, v = X.parse_route_responses(route_responses(spark, d), "route_id")
    return v.select("route_id", "seq", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


@query(
    "parse_route_headers",
    """SELECT DISTINCT l_orderkey AS route_id, CASE WHEN l_orderkey % 3 = 2 AND l_orderkey % 12 <> 2 THEN 'A' || (l_orderkey % 90) ELSE 'Route' END AS name,
 CASE l_orderkey % 3 WHEN 0 THEN CAST(l_orderkey % 1000 + 0.5e0 AS VARCHAR) WHEN 1 THEN CAST(l_orderkey * 1000 AS VARCHAR) ELSE CASE WHEN l_orderkey % 12 <> 2 THEN (l_orderkey % 60) || ' min' END END AS duration,
 CASE WHEN l_orderkey % 12 = 2 THEN 'REQUEST_DENIED' ELSE 'OK' END AS status, CASE WHEN l_orderkey % 12 = 2 THEN 403 END AS error_code,
 CASE WHEN l_orderkey % 3 = 1 THEN 'start|end' END AS steps FROM lineitem""",
)
def parse_route_headers(spark, d):
    h, _ = X.parse_route_responses(route_responses(spark, d), "route_id")
    return h.select("route_id", "name", "duration", "status", "error_code", F.array_join("instructions", "|").alias("steps"))


def _xml_routes(spark, d):
    v = vertices(spark, d)
    point = F.when(
        F.col("route_id") % 2 == 0,
        F.format_string("<Point><Latitude>%.4f</Latitude><Longitude>%.4f</Longitude></Point>", "lat", "lng"),
    ).otherwise(F.format_string('<wpt lat="%.4f" lon="%.4f"/>', "lat", "lng"))
    g = v.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "")
    bing = F.concat(
        F.lit("<Response><StatusCode>200</StatusCode><ResourceSets><ResourceSet><Resources><Route><RoutePath><Line>"), body,
        F.lit("</Line></RoutePath></Route></Resources></ResourceSet></ResourceSets></Response>"),
    )
    gpx = F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1">'), body, F.lit("</gpx>"))
    even = F.col("route_id") % 2 == 0
    return g.select("route_id", F.when(even, "bing").otherwise("gpx").alias("format"), F.when(even, bing).otherwise(gpx).alias("body"))


@query("parse_route_responses_xml", DECODED)
def parse_route_responses_xml(spark, d):
    _, v = X.parse_route_responses(_xml_routes(spark, d), "route_id")
    return v.select("route_id", "seq", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


def direction_responses(spark, d):
    """One leg per line item."""
    v = vertices(spark, d)

    def leg(at):
        loc = F.struct(at["lat"].alias("lat"), at["lng"].alias("lng"))
        amount = F.struct(F.concat(at["seq"] % 50, F.lit(" u")).alias("text"), (at["seq"] % 50).alias("value"))
        step = F.struct(
            F.lit("DRIVING").alias("travel_mode"), F.concat(F.lit("turn "), at["seq"] % 9).alias("html_instructions"),
            amount.alias("duration"), amount.alias("distance"), loc.alias("start_location"), loc.alias("end_location"),
        )
        return F.struct(
            amount.alias("duration"), amount.alias("distance"), loc.alias("start_location"), loc.alias("end_location"),
            F.concat(F.lit("from "), at["seq"] % 7).alias("start_address"), F.concat(F.lit("to "), at["seq"] % 11).alias("end_address"),
            F.array(step, step).alias("steps"),
        )

    # only the vertices are shuffled, their legs are written where they are gathered: long texts out of few bytes
    v = v.repartition(max(1, -(-v.count() // ROWS_PER_TASK)), "route_id")
    g = v.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("ls"))
    body = _obj(
        status=F.lit("OK"),
        routes=F.array(F.struct(F.lit("main").alias("summary"), F.transform("ls", leg).alias("legs"))),
    )
    return g.select("route_id", F.lit("google").alias("format"), body.alias("body"))


@query(
    "parse_directions",
    f"""WITH v AS ({RV}), n AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS leg FROM v)
SELECT route_id, CAST(NULL AS INTEGER) AS step, 'OK' AS status, 'main' AS summary, CAST(NULL AS VARCHAR) AS copyrights,
 string_agg((seq % 50) || ' u', ', ' ORDER BY seq) AS duration, CAST(sum(seq % 50) AS BIGINT) AS duration_value, string_agg((seq % 50) || ' u', ', ' ORDER BY seq) AS distance, CAST(sum(seq % 50) AS BIGINT) AS distance_value,
 round(arg_min(lat, seq), 6) AS start_lat, round(arg_min(lng, seq), 6) AS start_lng, round(arg_max(lat, seq), 6) AS end_lat, round(arg_max(lng, seq), 6) AS end_lng,
 'from ' || arg_min(seq % 7, seq) AS start_address, 'to ' || arg_max(seq % 11, seq) AS end_address, CAST(NULL AS VARCHAR) AS travel_mode, CAST(NULL AS VARCHAR) AS instructions, CAST(NULL AS VARCHAR) AS line FROM v GROUP BY 1
UNION ALL SELECT route_id, CAST(2 * leg + k AS INTEGER), NULL, NULL, NULL, (seq % 50) || ' u', NULL, (seq % 50) || ' u', NULL,
 round(lat, 6), round(lng, 6), round(lat, 6), round(lng, 6), NULL, NULL, 'DRIVING', 'turn ' || (seq % 9), NULL FROM n, (VALUES (0), (1)) t(k)""",
)
def parse_directions(spark, d):
    """Whole answers: a row with the totals of each (no step), and a row for each of its steps."""
    h, _ = X.parse_directions(direction_responses(spark, d), "route_id")
    kinds = dict(
        step="int", status="string", summary="string", copyrights="string", duration="string", duration_value="bigint", distance="string", distance_value="bigint",
        start_lat="double", start_lng="double", end_lat="double", end_lng="double", start_address="string", end_address="string",
        travel_mode="string", instructions="string", line="string",
    )

    def row(**values):
        return F.struct(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    own = ("status", "summary", "copyrights", "duration_value", "distance_value", "start_address", "end_address")
    both = ("duration", "distance", "start_lat", "start_lng", "end_lat", "end_lng")
    total = row(line=F.to_json("route"), **{c: F.col(c) for c in (*own, *both)})
    steps = F.transform("steps", lambda s, i: row(step=i, line=F.to_json(s["points"]), **{c: s[c] for c in (*both, "travel_mode", "instructions")}))
    rows = h.select("route_id", F.inline(F.concat(F.array(total), F.coalesce(steps, F.slice(F.array(total), 1, 0)))))
    return rows.withColumns({c: F.round(c, 6) for c in ("start_lat", "start_lng", "end_lat", "end_lng")})


@query(
    "parse_direction_steps",
    f"""WITH v AS ({RV}), n AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS leg FROM v)
SELECT route_id, CAST(2 * leg + k AS INTEGER) AS step, 'DRIVING' AS travel_mode, 'turn ' || (seq % 9) AS instructions, (seq % 50) || ' u' AS distance, round(lat, 6) AS start_lat FROM n, (VALUES (0), (1)) t(k)""",
)
def parse_direction_steps(spark, d):
    _, s = X.parse_directions(direction_responses(spark, d), "route_id")
    return s.select("route_id", "step", "travel_mode", "instructions", "distance", F.round("start_lat", 6).alias("start_lat"))


@query(
    "directions_totals",
    f"""WITH v AS ({RV}) SELECT route_id, CAST(sum(seq % 50) AS BIGINT) AS duration_value, string_agg((seq % 50) || ' u', ', ' ORDER BY seq) AS duration_text,
 CAST(sum(seq % 70) AS BIGINT) AS distance_value, round(arg_min(lat, seq), 6) AS start_lat, round(arg_max(lng, seq), 6) AS end_lng FROM v GROUP BY 1""",
)
def directions_totals(spark, d):
    v = vertices(spark, d)
    legs = v.withColumns(
        {
            "duration_value": F.col("seq") % 50, "duration_text": F.concat(F.col("seq") % 50, F.lit(" u")),
            "distance_value": F.col("seq") % 70, "distance_text": F.concat(F.col("seq") % 70, F.lit(" m")),
            "start_lat": F.col("lat"), "start_lng": F.col("lng"), "end_lat": F.col("lat"), "end_lng": F.col("lng"),
            "start_address": F.lit("a"), "end_address": F.lit("b"),
        }
    )
    t = R.directions_totals(legs, "route_id", "seq")
    return t.select(
        "route_id", "duration_value", "duration_text", "distance_value",
        F.round("start_lat", 6).alias("start_lat"), F.round("end_lng", 6).alias("end_lng"),
    )


@query("parse_snapped_points", f"SELECT * FROM ({DECODED}) WHERE route_id % 10 <> 3")
def parse_snapped_points(spark, d):
    v = vertices(spark, d)
    at = F.struct(F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("location"))
    g = v.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", at.alias("p")))).alias("ps"))
    ok = _obj(snappedPoints=F.transform("ps", lambda x: x["p"]))
    bad = F.lit('{"error":{"code":400,"message":"bad path","status":"INVALID_ARGUMENT"}}')
    r = g.select("route_id", F.when(F.col("route_id") % 10 == 3, bad).otherwise(ok).alias("body"))
    _, s = X.parse_snapped_points(r, "route_id")
    return s.select("route_id", "seq", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


CU = P.sql_points("customer", "c_custkey", "region", "c_custkey")


def geocode_responses(spark, d):
    c = P.customer_points(spark, d)
    k, lat, lng = F.col("c_custkey"), F.col("lat"), F.col("lng")
    pt = F.struct(lat.alias("lat"), lng.alias("lng"))
    nominatim = F.to_json(F.array(F.struct(lat.cast("string").alias("lat"), lng.cast("string").alias("lon"))))
    hopper = _obj(hits=F.array(F.struct(pt.alias("point")), F.struct(pt.alias("point"))))
    google = F.when(k % 10 == 2, F.lit('{"status":"ZERO_RESULTS","results":[]}')).otherwise(
        _obj(status=F.lit("OK"), results=F.array(F.struct(F.struct(pt.alias("location")).alias("geometry"))))
    )
    yahoo = F.format_string(
        "<ResultSet><Result><quality>%d</quality><latitude>%.4f</latitude><longitude>%.4f</longitude></Result></ResultSet>",
        k % 80, lat, lng,
    )
    bing = F.when(k % 15 == 4, F.lit("<Response><StatusCode>401</StatusCode></Response>")).otherwise(
        F.format_string(
            "<Response><StatusCode>200</StatusCode><ResourceSets><ResourceSet><Resources><Location><Point><Latitude>%.4f</Latitude>"
            "<Longitude>%.4f</Longitude></Point></Location></Resources></ResourceSet></ResourceSets></Response>", lat, lng,
        )
    )
    names = F.array(*[F.lit(n) for n in ("nominatim", "graphhopper", "google", "yahoo", "bing")])
    i = (k % 5).cast("int")
    return c.select(
        "c_custkey", F.element_at(names, i + 1).alias("format"),
        F.when(i == 0, nominatim).when(i == 1, hopper).when(i == 2, google).when(i == 3, yahoo).otherwise(bing).alias("body"),
    )


@query(
    "parse_geocodes",
    f"""WITH c AS ({CU}), r AS (SELECT *, CASE WHEN c_custkey % 10 = 2 THEN 'ZERO_RESULTS' WHEN c_custkey % 15 = 4 AND c_custkey % 5 = 4 THEN 'REQUEST_DENIED' ELSE 'OK' END AS status,
 CASE WHEN c_custkey % 10 = 2 OR (c_custkey % 5 = 4 AND c_custkey % 15 = 4) OR (c_custkey % 5 = 3 AND c_custkey % 80 < {X.YAHOO_MIN_QUALITY}) THEN 0 WHEN c_custkey % 5 = 1 THEN 2 ELSE 1 END AS n FROM c)
SELECT c_custkey, status, CAST(k AS INTEGER) AS seq, round(lat, 5) AS lat, round(lng, 5) AS lng FROM r, (VALUES (0), (1)) t(k) WHERE k < n
UNION ALL SELECT c_custkey, status, NULL, NULL, NULL FROM r WHERE n = 0""",
)
def parse_geocodes(spark, d):
    g = X.parse_geocodes(geocode_responses(spark, d), "c_custkey")
    return g.select("c_custkey", "status", "seq", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


@query(
    "parse_placemarks",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 7 END AS placemark_id, c_name AS address, 'Land' AS country,
 CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Town ' || (c_custkey % 11) ELSE 'Hamlet ' || (c_custkey % 13) END WHEN 1 THEN 'City ' || (c_custkey % 17) ELSE 'Sub ' || (c_custkey % 19) END AS sub_admin_area,
 CASE WHEN c_custkey % 3 <> 1 THEN 'Road ' || (c_custkey % 5) END AS thoroughfare FROM customer""",
)
def parse_placemarks(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    town = F.when(k % 2 == 0, F.concat(F.lit("Town "), k % 11)).otherwise("")
    address = F.struct(
        F.lit("Land").alias("country"), F.lit("").alias("city"), town.alias("town"),
        F.concat(F.lit("Hamlet "), k % 13).alias("hamlet"), F.concat(F.lit("Road "), k % 5).alias("road"),
    )
    nominatim = _obj(place_id=k, display_name=F.col("c_name"), address=address)
    hopper = _obj(
        hits=F.array(
            F.struct((k + 7).alias("osm_id"), F.col("c_name").alias("name"), F.lit("Land").alias("country"), F.concat(F.lit("City "), k % 17).alias("city"))
        )
    )

    def part(text, kind):
        return F.struct(text.alias("long_name"), F.array(F.lit(kind), F.lit("political")).alias("types"))

    google = _obj(
        status=F.lit("OK"),
        results=F.array(
            F.struct(
                F.col("c_name").alias("formatted_address"),
                F.array(
                    part(F.lit("Land"), "country"), part(F.concat(F.lit("Sub "), k % 19), "administrative_area_level_3"),
                    part(F.concat(F.lit("Road "), k % 5), "route"),
                ).alias("address_components"),
            )
        ),
    )
    r = c.select(
        "c_custkey", F.element_at(F.array(F.lit("nominatim"), F.lit("graphhopper"), F.lit("google")), (k % 3 + 1).cast("int")).alias("format"),
        F.when(k % 3 == 0, nominatim).when(k % 3 == 1, hopper).otherwise(google).alias("body"),
    )
    p = X.parse_placemarks(r, "c_custkey")
    return p.select("c_custkey", "placemark_id", "address", "country", "sub_admin_area", "thoroughfare")


@query(
    "parse_center_lookup",
    f"""WITH v AS ({RV}), b AS (SELECT o_orderkey, 49.2e0 + (o_orderkey % 3) * 0.1e0 AS bottom, 49.2e0 + (o_orderkey % 3) * 0.1e0 + 0.5e0 AS top, 5.6e0 + (o_orderkey % 4) * 0.05e0 AS l, 5.6e0 + (o_orderkey % 4) * 0.05e0 + 0.6e0 AS r,
 CASE WHEN o_orderkey % 2 = 0 THEN 49.5e0 END AS ala, CASE WHEN o_orderkey % 2 = 0 THEN 6e0 END AS aln FROM orders),
j AS (SELECT route_id, seq, lat, lng, {S.hav('coalesce(ala, (top + bottom) / 2)', 'coalesce(aln, (l + r) / 2)', 'lat', 'lng', 6371000)} AS m FROM v JOIN b ON o_orderkey = route_id WHERE lat BETWEEN bottom AND top AND lng BETWEEN l AND r)
SELECT route_id, arg_min(lat, (m, seq)) AS lat, arg_min(lng, (m, seq)) AS lng FROM j GROUP BY 1""",
)
def parse_center_lookup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    b = o.withColumns(
        {
            "r_bottom": F.lit(49.2) + (k % 3) * F.lit(0.1), "r_top": F.lit(49.2) + (k % 3) * F.lit(0.1) + 0.5,
            "r_left": F.lit(5.6) + (k % 4) * F.lit(0.05), "r_right": F.lit(5.6) + (k % 4) * F.lit(0.05) + 0.6,
            "anchor_lat": F.when(k % 2 == 0, F.lit(49.5)), "anchor_lng": F.when(k % 2 == 0, F.lit(6.0)),
        }
    )
    j = vertices(spark, d).join(b, F.col("route_id") == k)
    return X.parse_center_lookup(j, "route_id").select("route_id", "lat", "lng")


OUTCOME = """CASE WHEN event_id % 9 = 1 OR event_id % 11 = 2 OR 100 * (2 + event_id % 4) + event_id % 30 IN (408, 429) OR 100 * (2 + event_id % 4) + event_id % 30 >= 500 THEN 'transient'
 WHEN 100 * (2 + event_id % 4) + event_id % 30 < 300 THEN CASE WHEN value > 20 THEN 'success' ELSE 'not_found' END ELSE 'permanent' END"""


def outcomes(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "value", "ts")
    k = F.col("event_id")
    code = F.when(k % 9 == 1, F.lit(None)).otherwise((k % 4 + 2) * 100 + k % 30).cast("int")
    return ev.withColumn("outcome", X.classify_fetch_outcome(code, F.col("value") > 20, k % 11 == 2))


@query("classify_fetch_outcome", f"SELECT event_id, {OUTCOME} AS outcome FROM events")
def classify_fetch_outcome(spark, d):
    return outcomes(spark, d).select("event_id", "outcome")


@query(
    "provider_outcomes",
    f"""WITH o AS (SELECT user_id % 6 AS provider, {OUTCOME} AS outcome, value FROM events)
SELECT provider, count(*) AS attempted, count(*) FILTER (outcome = 'success') AS with_polygon, count(*) FILTER (outcome = 'success' AND value > 40) AS with_center,
 bool_or(outcome = 'transient') AS any_transient, bool_and(outcome = 'not_found') AS all_not_found FROM o GROUP BY 1""",
)
def provider_outcomes(spark, d):
    from geoloom.operators.summaries import provider_outcomes as summary

    o = outcomes(spark, d).withColumns(
        {
            "provider": F.col("user_id") % 6,
            "has_polygon": F.col("outcome") == "success",
            "has_center": (F.col("outcome") == "success") & (F.col("value") > 40),
        }
    )
    return summary(o)


@query("fresh_responses", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 240 HOUR")
def fresh_responses(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts")
    now = ev.agg(F.max("ts").alias("now"))
    return X.fresh_responses(beside_one_row(ev, now), F.col("now"), 240.0, "ts").select("event_id")
