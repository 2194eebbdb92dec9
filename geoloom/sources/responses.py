"""Stored web-service answers to route, step, geocode and address tables.

Input is a table of responses: a key column, ``format`` and ``body``. Every
parser reads the table once; a body is parsed only by the branch of its format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import polyline
from geoloom.functions.geodesy import distance_m
from geoloom.functions.rects import in_bounds, rect

POINTS = "array<struct<lat:double,lng:double>>"

# fixed values: shapes of the answers
OSRM_ROUTE = "routes array<struct<duration:double,geometry:string>>"
GRAPHHOPPER_ROUTE = "paths array<struct<time:bigint,points:string,instructions:array<struct<text:string>>>>"
GOOGLE_ERROR = "error struct<code:int,message:string,status:string>"
GOOGLE_ROUTE = (
    f"status string, {GOOGLE_ERROR}, routes array<struct<summary:string,"
    "overview_polyline:struct<points:string>,legs:array<struct<duration:struct<text:string>>>>>"
)
LOCATION = "struct<lat:double,lng:double>"
AMOUNT = "struct<text:string,value:bigint>"
GOOGLE_DIRECTIONS = (
    "status string, routes array<struct<summary:string,copyrights:string,overview_polyline:struct<points:string>,"
    f"legs:array<struct<duration:{AMOUNT},distance:{AMOUNT},start_location:{LOCATION},end_location:{LOCATION},"
    "start_address:string,end_address:string,"
    f"steps:array<struct<travel_mode:string,html_instructions:string,duration:{AMOUNT},distance:{AMOUNT},"
    f"start_location:{LOCATION},end_location:{LOCATION},polyline:struct<points:string>>>>>>>"
)
SNAPPED = (
    f"warningMessage string, {GOOGLE_ERROR}, "
    "snappedPoints array<struct<location:struct<latitude:double,longitude:double>>>"
)
BING_ROUTE = (
    "StatusCode string, ResourceSets struct<ResourceSet:struct<Resources:struct<Route:struct<RoutePath:"
    "struct<Line:struct<Point:array<struct<Latitude:double,Longitude:double>>>>>>>>"
)
BING_PLACES = (
    "StatusCode string, ResourceSets struct<ResourceSet:struct<Resources:struct<Location:"
    "array<struct<Point:struct<Latitude:double,Longitude:double>>>>>>"
)
GPX_POINT = "struct<_lat:double,_lon:double>"
GPX_ROUTE = (
    f"wpt array<{GPX_POINT}>, metadata struct<copyright:struct<license:string>>, "
    "extensions struct<distance:string,time:string,start:string,end:string>, "
    "rte struct<rtept:array<struct<_lat:double,_lon:double,desc:string,"
    "extensions:struct<`distance-text`:string,time:string>>>>"
)
NOMINATIM_ADDRESS = (
    "struct<country:string,country_code:string,postcode:string,state:string,city:string,town:string,"
    "village:string,hamlet:string,suburb:string,road:string>"
)
NOMINATIM_PLACE = f"place_id bigint, display_name string, address {NOMINATIM_ADDRESS}"
GRAPHHOPPER_PLACES = (
    "hits array<struct<point:struct<lat:double,lng:double>,osm_id:bigint,name:string,country:string,"
    "countrycode:string,postcode:string,state:string,city:string>>"
)
GOOGLE_PLACES = (
    f"status string, results array<struct<formatted_address:string,geometry:struct<location:{LOCATION}>,"
    "address_components:array<struct<long_name:string,types:array<string>>>>>"
)
YAHOO_PLACES = (
    "Result array<struct<quality:int,latitude:double,longitude:double,name:string,level0:string,level0code:string,"
    "postal:string,level1:string,level2:string,level3:string,level4:string,street:string,house:string,radius:int>>"
)
YAHOO_MIN_QUALITY = 39
XML_STATUS = {
    "400": "INVALID_REQUEST", "401": "REQUEST_DENIED", "403": "INVALID_REQUEST", "404": "ZERO_RESULTS",
    "500": "ERROR", "501": "UNKNOWN_ERROR",
}
ADDRESS_TYPES = {
    "street_number": "street_number", "street_address": "street_address", "route": "thoroughfare",
    "postal_code": "postal_code", "country": "country", "locality": "locality",
    "administrative_area_level_2": "district", "administrative_area_level_1": "admin_area",
    "administrative_area_level_3": "sub_admin_area", "neighborhood": "neighborhood",
}
PLACEMARK_FIELDS = (
    "placemark_id", "address", "country", "country_code", "postal_code", "admin_area", "sub_admin_area",
    "locality", "district", "thoroughfare", "street_number", "street_address", "house", "neighborhood", "accuracy",
)
# ---- end of fixed values ----


def _json(fmt: str, schema: str, body: str = "body") -> Column:
    return F.when(F.col("format") == fmt, F.from_json(F.col(body), schema))


def _xml(fmt: str, schema: str, body: str = "body") -> Column:
    return F.when(F.col("format") == fmt, F.from_xml(F.col(body), schema, {"ignoreNamespace": "true"}))


def _first(arr: str) -> Column:
    return F.get(F.col(arr), F.lit(0))


def _points(arr: Column, lat: str, lng: str) -> Column:
    return F.transform(arr, lambda p: F.struct(p[lat].alias("lat"), p[lng].alias("lng")))


def _line(encoded: Column) -> Column:
    """Points of an encoded line, NULL without one."""
    return F.when(encoded.isNotNull(), polyline.decode(encoded))


def parse_route_responses(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(headers, vertices) of route answers in the osrm, graphhopper, google, bing
    and gpx formats."""
    p = df.select(
        key,
        "format",
        _json("osrm", OSRM_ROUTE).alias("o"),
        _json("graphhopper", GRAPHHOPPER_ROUTE).alias("h"),
        _json("google", GOOGLE_ROUTE).alias("g"),
        _xml("bing", BING_ROUTE).alias("b"),
        _xml("gpx", GPX_ROUTE).alias("x"),
    )
    osrm, hopper, google = _first("o.routes"), _first("h.paths"), _first("g.routes")
    line = F.col("b.ResourceSets.ResourceSet.Resources.Route.RoutePath.Line.Point")
    ok_google = F.col("g.error").isNull()
    encoded = F.coalesce(osrm["geometry"], hopper["points"], F.when(ok_google, google["overview_polyline"]["points"]))
    bing_points = F.when(F.col("b.StatusCode") == "200", _points(line, "Latitude", "Longitude"))
    p = p.withColumn("encoded", encoded)
    points = F.coalesce(
        F.when(F.col("encoded").isNotNull(), polyline.decode("encoded")), bing_points, _points(F.col("x.wpt"), "_lat", "_lon")
    )
    has_plain = F.coalesce(osrm["geometry"], hopper["points"]).isNotNull() | bing_points.isNotNull() | (F.size("x.wpt") > 0)
    status = (
        F.when(F.col("g").isNotNull(), F.when(ok_google, F.col("g.status")).otherwise(F.col("g.error.status")))
        .when(has_plain, "OK")
        .otherwise("UNKNOWN_ERROR")
    )
    routes = p.select(
        key,
        F.coalesce(F.when(ok_google, google["summary"]), F.lit("Route")).alias("name"),
        F.coalesce(
            osrm["duration"].cast("string"), hopper["time"].cast("string"), F.get(google["legs"], F.lit(0))["duration"]["text"]
        ).alias("duration"),
        status.alias("status"),
        F.col("g.error.code").alias("error_code"),
        F.col("g.error.message").alias("error_message"),
        F.transform(hopper["instructions"], lambda i: i["text"]).alias("instructions"),
        points.alias("points"),
    )
    vertices = routes.select(key, F.posexplode("points").alias("seq", "v")).select(key, "seq", "v.lat", "v.lng")
    return routes.drop("points"), vertices


def parse_directions(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(headers with totals across legs, the line of the route and all steps, one row per step with its line) of directions answers."""
    p = df.select(key, "format", _json("google", GOOGLE_DIRECTIONS).alias("g"), _xml("gpx", GPX_ROUTE).alias("x"))
    route = F.when(F.col("g.status") == "OK", _first("g.routes"))
    p = p.withColumn("r", route)
    legs, wpt, ext = F.col("r.legs"), F.col("x.wpt"), F.col("x.extensions")
    zero = F.lit(0).cast("bigint")

    def total(part: str) -> Column:
        return F.aggregate(legs, zero, lambda acc, leg: acc + F.coalesce(leg[part]["value"], zero))

    def texts(part: str) -> Column:
        return F.array_join(F.transform(legs, lambda leg: leg[part]["text"]), ", ")

    first, last = F.get(legs, F.lit(0)), F.try_element_at(legs, F.lit(-1))
    first_w, last_w = F.get(wpt, F.lit(0)), F.try_element_at(wpt, F.lit(-1))
    gpx_ok = F.size(wpt) > 0
    google_steps = F.flatten(
        F.transform(
            legs,
            lambda leg: F.transform(
                leg["steps"],
                lambda s: F.struct(
                    s["travel_mode"].alias("travel_mode"), s["html_instructions"].alias("instructions"),
                    s["duration"]["text"].alias("duration"), s["distance"]["text"].alias("distance"),
                    s["start_location"]["lat"].alias("start_lat"), s["start_location"]["lng"].alias("start_lng"),
                    s["end_location"]["lat"].alias("end_lat"), s["end_location"]["lng"].alias("end_lng"),
                    s["polyline"]["points"].alias("polyline"),
                    _line(s["polyline"]["points"]).alias("points"),
                ),
            ),
        )
    )
    nothing = F.lit(None)
    gpx_steps = F.transform(
        F.col("x.rte.rtept"),
        lambda s: F.struct(
            nothing.cast("string").alias("travel_mode"), s["desc"].alias("instructions"),
            F.concat(s["extensions"]["time"], F.lit("s")).alias("duration"),
            s["extensions"]["distance-text"].alias("distance"),
            s["_lat"].alias("start_lat"), s["_lon"].alias("start_lng"),
            nothing.cast("double").alias("end_lat"), nothing.cast("double").alias("end_lng"),
            nothing.cast("string").alias("polyline"), nothing.cast(POINTS).alias("points"),
        ),
    )
    all_steps = F.coalesce(google_steps, F.when(gpx_ok, gpx_steps))
    headers = p.select(
        key,
        F.coalesce(F.col("g.status"), F.when(gpx_ok, "OK"), F.lit("UNKNOWN_ERROR")).alias("status"),
        F.col("r.summary").alias("summary"),
        F.coalesce("r.copyrights", "x.metadata.copyright.license").alias("copyrights"),
        F.coalesce(texts("duration"), F.concat(ext["time"], F.lit("s"))).alias("duration"),
        total("duration").alias("duration_value"),
        F.coalesce(texts("distance"), F.concat(ext["distance"], F.lit("m"))).alias("distance"),
        total("distance").alias("distance_value"),
        F.coalesce(first["start_location"]["lat"], first_w["_lat"]).alias("start_lat"),
        F.coalesce(first["start_location"]["lng"], first_w["_lon"]).alias("start_lng"),
        F.coalesce(last["end_location"]["lat"], last_w["_lat"]).alias("end_lat"),
        F.coalesce(last["end_location"]["lng"], last_w["_lon"]).alias("end_lng"),
        F.coalesce(first["start_address"], ext["start"]).alias("start_address"),
        F.coalesce(last["end_address"], ext["end"]).alias("end_address"),
        F.coalesce(_line(F.col("r.overview_polyline.points")), F.when(gpx_ok, _points(wpt, "_lat", "_lon"))).alias("route"),
        all_steps.alias("steps"),
    )
    return headers, p.select(key, F.posexplode(all_steps).alias("step", "s")).select(key, "step", "s.*")


def parse_snapped_points(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    p = df.select(key, F.from_json("body", SNAPPED).alias("s"))
    ok = F.col("s.error").isNull()
    headers = p.select(
        key,
        F.col("s.warningMessage").alias("warning"),
        F.when(ok & (F.size("s.snappedPoints") > 0), "OK").otherwise(
            F.coalesce("s.error.status", F.lit("UNKNOWN_ERROR"))
        ).alias("status"),
        F.col("s.error.code").alias("error_code"),
        F.col("s.error.message").alias("error_message"),
    )
    vertices = p.filter(ok).select(key, F.posexplode("s.snappedPoints").alias("seq", "v")).select(
        key, "seq", F.col("v.location.latitude").alias("lat"), F.col("v.location.longitude").alias("lng")
    )
    return headers, vertices


def parse_geocodes(df: DataFrame, key: str) -> DataFrame:
    """One row per returned point, or one row with the status alone."""
    p = df.select(
        key,
        F.when(F.col("format") == "nominatim", F.from_json("body", "array<struct<lat:string,lon:string>>")).alias("n"),
        _json("graphhopper", GRAPHHOPPER_PLACES).alias("h"),
        _json("google", GOOGLE_PLACES).alias("g"),
        _xml("yahoo", YAHOO_PLACES).alias("y"),
        _xml("bing", BING_PLACES).alias("b"),
    )
    nominatim = F.transform(
        F.col("n"), lambda v: F.struct(v["lat"].try_cast("double").alias("lat"), v["lon"].try_cast("double").alias("lng"))
    )
    google = F.transform(
        F.when(F.col("g.status") == "OK", F.col("g.results")),
        lambda v: F.struct(v["geometry"]["location"]["lat"].alias("lat"), v["geometry"]["location"]["lng"].alias("lng")),
    )
    yahoo = _points(F.filter("y.Result", lambda v: v["quality"] >= YAHOO_MIN_QUALITY), "latitude", "longitude")
    bing = F.when(
        F.col("b.StatusCode") == "200",
        F.transform(
            "b.ResourceSets.ResourceSet.Resources.Location",
            lambda v: F.struct(v["Point"]["Latitude"].alias("lat"), v["Point"]["Longitude"].alias("lng")),
        ),
    )
    hopper = F.transform("h.hits", lambda v: F.struct(v["point"]["lat"].alias("lat"), v["point"]["lng"].alias("lng")))
    bing_status = F.when(F.col("b.StatusCode") == "200", F.when(F.size(bing) > 0, "OK").otherwise("ZERO_RESULTS"))
    for code, text in XML_STATUS.items():
        bing_status = bing_status.when(F.col("b.StatusCode") == code, text)
    status = (
        F.when(F.col("g").isNotNull(), F.col("g.status"))
        .when(F.col("b").isNotNull(), bing_status)
        .when(F.coalesce(nominatim, yahoo, hopper).isNotNull(), "OK")
    )
    out = p.select(
        key,
        F.coalesce(status, F.lit("UNKNOWN_ERROR")).alias("status"),
        F.posexplode_outer(F.coalesce(nominatim, hopper, google, yahoo, bing)).alias("seq", "v"),
    )
    return out.select(key, "status", "seq", "v.lat", "v.lng")


def _placemark(**values: Column) -> Column:
    kinds = {"placemark_id": "bigint", "accuracy": "int"}
    return F.struct(
        *[values.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in PLACEMARK_FIELDS]
    )


def parse_placemarks(df: DataFrame, key: str) -> DataFrame:
    """Reverse-geocoder answers to one flat address row each."""
    p = df.select(
        key,
        _json("nominatim", NOMINATIM_PLACE).alias("n"),
        _json("graphhopper", GRAPHHOPPER_PLACES).alias("h"),
        _json("google", GOOGLE_PLACES).alias("g"),
        _xml("yahoo", YAHOO_PLACES).alias("y"),
    )
    a = F.col("n.address")
    nominatim = F.when(
        F.col("n").isNotNull(),
        F.array(
            _placemark(
                placemark_id=F.col("n.place_id"), address=F.col("n.display_name"), country=a["country"],
                country_code=a["country_code"], postal_code=a["postcode"], admin_area=a["state"],
                sub_admin_area=F.coalesce(
                    *[F.when(a[k] != "", a[k]) for k in ("city", "town", "village", "hamlet")]
                ),
                locality=a["suburb"], thoroughfare=a["road"],
            )
        ),
    )
    hopper = F.transform(
        "h.hits",
        lambda v: _placemark(
            placemark_id=v["osm_id"], address=v["name"], country=v["country"], country_code=v["countrycode"],
            postal_code=v["postcode"], admin_area=v["state"], sub_admin_area=v["city"],
        ),
    )

    def component(v: Column, kind: str) -> Column:
        hits = F.filter(v["address_components"], lambda c: F.get(c["types"], F.lit(0)) == kind)
        return F.try_element_at(hits, F.lit(-1))["long_name"]

    google = F.transform(
        F.when(F.col("g.status") == "OK", F.col("g.results")),
        lambda v: _placemark(
            address=v["formatted_address"], **{name: component(v, kind) for kind, name in ADDRESS_TYPES.items()}
        ),
    )
    yahoo = F.transform(
        F.filter("y.Result", lambda v: v["name"].isNotNull()),
        lambda v: _placemark(
            address=v["name"], country=v["level0"], country_code=v["level0code"], postal_code=v["postal"],
            admin_area=v["level1"], sub_admin_area=v["level2"], locality=v["level3"], district=v["level4"],
            thoroughfare=v["street"], house=v["house"], accuracy=v["radius"],
        ),
    )
    return p.select(key, F.posexplode(F.coalesce(nominatim, hopper, google, yahoo)).alias("seq", "v")).select(key, "seq", "v.*")


def parse_center_lookup(
    points: DataFrame, key: str, bounds: str = "r", lat: str = "lat", lng: str = "lng",
    anchor_lat: str = "anchor_lat", anchor_lng: str = "anchor_lng", tie: str = "seq",
) -> DataFrame:
    """The answer nearest to the anchor (else to the middle of the bounds) among
    those inside the bounds."""
    r = rect(bounds)
    ref_lat = F.coalesce(F.col(anchor_lat), (r.top + r.bottom) / 2)
    ref_lng = F.coalesce(F.col(anchor_lng), (r.left + r.right) / 2)
    inside = points.filter(in_bounds(lat, lng, r, "closed"))
    d = distance_m(ref_lat, ref_lng, lat, lng)
    best = inside.groupBy(key).agg(
        F.min(F.struct(d.alias("distance_m"), F.col(tie), F.col(lat), F.col(lng))).alias("b")
    )
    return best.select(key, F.col(f"b.{lat}").alias(lat), F.col(f"b.{lng}").alias(lng), "b.distance_m")


def classify_fetch_outcome(status: Column, has_data: Column, timed_out: Column) -> Column:
    """success, not_found, transient or permanent. Time-outs, missing codes, 408,
    429 and 5xx may be retried."""
    transient = timed_out | status.isNull() | status.isin(408, 429) | (status >= 500)
    return (
        F.when(F.coalesce(transient, F.lit(True)), "transient")
        .when((status >= 200) & (status < 300), F.when(has_data, "success").otherwise("not_found"))
        .otherwise("permanent")
    )


def fresh_responses(df: DataFrame, now: Column, ttl_hours: float | None = 240.0, fetched: str = "fetched_at") -> DataFrame:
    """Responses younger than the limit (100 days when there is none)."""
    hours = 2400.0 if ttl_hours is None else ttl_hours
    return df.filter(F.col(fetched) > now - F.make_dt_interval(hours=F.lit(int(hours)), secs=F.lit(hours % 1 * 3600)))
