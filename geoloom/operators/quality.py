"""Checking, scoring and rejecting boundary candidates and centers.

Polygon rows: poly_id (unique), place_id, provider, external_id, priority,
utm_zone, outer, holes, explicit_link. Places: place_id, name, place, osm_type,
osm_id and the point columns. Centers: place_id, provider, external_id, priority,
updated_at and the point columns.

The order of stages is fixed: centers by priority, polygons, centers by score.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom import rules
from geoloom.functions import rings as G
from geoloom.functions.geodesy import projected_distance_m
from geoloom.operators.matching import low, place_names, same_instance_groups
from geoloom.operators.proximity import near_pairs, point_side
from geoloom.operators.ranking import REJECTED, effective_score, first_match
from geoloom.operators import shape_tiles as T
from geoloom.operators.skew import skew_join
from geoloom.operators.spatial import pairs_in_polygons, with_nearby_zones
from geoloom.operators.utm import reproject_zone
from geoloom.session import cut_lineage

POINT = ("x", "y", "utm_zone", "lat", "lng")
#: Spots of a place that are all compared with each other.
FEW_SPOTS = 256
#: Vertices of a ring whose edges are all compared with each other.
SMALL_RING = 64
MANY_POLYGONS = 1_000_000  # numbers of polygons, more are not broadcast


def _rings(df: DataFrame) -> DataFrame:
    """One row per ring: ring_no 0 is the outer one; repeated vertices are dropped."""
    holes = F.coalesce(F.col("holes"), F.array().cast(f"array<{G.RING}>"))
    r = df.select("poly_id", F.posexplode(F.concat(F.array(F.col("outer")), holes)).alias("ring_no", "ring"))
    return r.withColumn("ring", G.drop_repeated("ring"))


def valid_ring(ring: str) -> Column:
    """At least three vertices, all finite, an area of at least 1 m2."""
    finite = F.forall(ring, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < 1e300) & (F.abs(p["y"]) < 1e300))
    return F.coalesce((F.size(ring) >= 3) & finite & (G.ring_area(ring) >= rules.LEAST_RING_AREA), F.lit(False))


def edge_crossings(rings: DataFrame) -> DataFrame:
    """poly_id, r1, r2 (r1 <= r2): rings of a polygon that touch or cross; r1 = r2
    is a ring that meets itself in non-adjacent edges.

    The edges of a ring of at most ``SMALL_RING`` vertices are compared where the ring lies. Only polygons with
    longer or several rings go through :func:`_crossings_on_grid`.
    """
    rings = rings.filter(F.size("ring") >= 3).select("poly_id", "ring_no", "ring")
    mark = F.xxhash64("ring_no", "ring")
    more = rings.groupBy("poly_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b"), F.max(F.size("ring")).alias("n"))
    more = cut_lineage(more.filter((F.col("a") != F.col("b")) | (F.col("n") > SMALL_RING)).select("poly_id"))
    met, n = _crossings_in_ring(rings.filter(F.size("ring") <= SMALL_RING)), more.count()
    if n:
        large = rings.join(F.broadcast(more) if n <= MANY_POLYGONS else more, "poly_id", "left_semi")
        met = met.unionByName(_crossings_on_grid(large))
    return met.distinct()


def _crossings_in_ring(rings: DataFrame) -> DataFrame:
    """poly_id, r1, r2 of rings that meet themselves, without a shuffle: each pair of edges that are not neighbours."""
    r = rings.filter(F.col("poly_id").isNotNull() & F.col("ring_no").isNotNull()).withColumn("n", F.size("ring")).filter("n >= 4")
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 3)))
    # the last edge is a neighbour of the first one
    r = r.withColumn("j", F.explode(F.sequence(F.col("i") + 2, F.when(F.col("i") == 0, F.col("n") - 2).otherwise(F.col("n") - 1))))
    i, j = F.col("i"), F.col("j")
    ends = [F.get("ring", at) for at in (i, i + 1, j, F.when(j + 1 < F.col("n"), j + 1).otherwise(0))]
    flat = [v[axis].alias(f"{axis}{k}") for k, v in enumerate(ends) for axis in "xy"]
    # a generator of one row: no filter is moved below it, so each coordinate is looked up once
    r = r.select("poly_id", "ring_no", F.inline(F.array(F.struct(*flat))))
    e1, e2 = ({"ax": F.col(f"x{k}"), "ay": F.col(f"y{k}"), "bx": F.col(f"x{k + 1}"), "by": F.col(f"y{k + 1}")} for k in (0, 2))
    whole = reduce(and_, [F.col(f"{axis}{k}").isNotNull() for k in range(4) for axis in "xy"])
    met = r.filter(whole & G.segments_intersect(e1, e2))
    return met.select("poly_id", F.col("ring_no").alias("r1"), F.col("ring_no").alias("r2"))


def _crossings_on_grid(rings: DataFrame) -> DataFrame:
    """:func:`edge_crossings` of any polygons.

    Edges of a polygon meet on a grid as fine as its average edge, so a ring of n
    vertices costs about n rows instead of n squared pairs.
    """
    e = rings.filter(F.size("ring") >= 3).select("poly_id", "ring_no", F.size("ring").alias("n"), "ring")
    box = G.bounding("ring")
    size = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    step = F.greatest(F.lit(1.0), size / F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.col("n"))).cast("double")))
    # one grid per polygon: the coarsest of its rings' steps would crowd, the finest would scatter
    e = e.withColumn("__step", step)
    w = W.partitionBy("poly_id")
    e = e.withColumn("__cell", F.avg("__step").over(w)).drop("__step")
    e = e.select("poly_id", "ring_no", "n", "__cell", F.posexplode(G.corners(F.col("ring"))).alias("i", "e"))
    span = F.greatest(F.abs(F.col("e.bx") - F.col("e.ax")), F.abs(F.col("e.by") - F.col("e.ay")))
    e = e.withColumn("__k", F.greatest(F.lit(1), F.ceil(span / F.col("__cell")).cast("int")))
    e = e.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    eps = G.EPSILON_M

    def at(f: Column, a: str, b: str) -> Column:
        return F.col(f"e.{a}") + (F.col(f"e.{b}") - F.col(f"e.{a}")) * f

    f0, f1 = F.col("__j") / F.col("__k"), (F.col("__j") + 1) / F.col("__k")
    xs, ys = (at(f0, "ax", "bx"), at(f1, "ax", "bx")), (at(f0, "ay", "by"), at(f1, "ay", "by"))
    cell = F.col("__cell")
    e = e.withColumn("cx", F.explode(F.sequence(F.floor((F.least(*xs) - eps) / cell), F.floor((F.greatest(*xs) + eps) / cell))))
    e = e.withColumn("cy", F.explode(F.sequence(F.floor((F.least(*ys) - eps) / cell), F.floor((F.greatest(*ys) + eps) / cell))))
    e = cut_lineage(e.select("poly_id", "ring_no", "n", "i", "e", "cx", "cy").distinct())
    a = e.select("poly_id", "cx", "cy", F.col("ring_no").alias("r1"), F.col("n").alias("n1"), F.col("i").alias("i1"), F.col("e").alias("e1"))
    b = e.select("poly_id", "cx", "cy", F.col("ring_no").alias("r2"), F.col("i").alias("i2"), F.col("e").alias("e2"))
    later = (F.col("r1") < F.col("r2")) | (
        (F.col("r1") == F.col("r2")) & (F.col("i2") - F.col("i1") > 1) & (F.col("i2") - F.col("i1") != F.col("n1") - 1)
    )
    met = skew_join(a, b, ["poly_id", "cx", "cy"]).filter(later & G.segments_intersect(F.col("e1"), F.col("e2")))
    return met.select("poly_id", "r1", "r2")


def geometry_errors(polygons: DataFrame) -> DataFrame:
    """poly_id, error: the first fault of a polygon in the order of the checks."""
    rings = cut_lineage(_rings(polygons))
    checks = rings.select("poly_id", "ring_no", valid_ring("ring").alias("valid"), F.col("ring"))
    crossed = cut_lineage(edge_crossings(rings.filter(valid_ring("ring"))))
    own = crossed.filter("r1 = r2").select("poly_id", F.col("r1").alias("ring_no"), F.lit(True).alias("crosses"))
    outer = rings.filter("ring_no = 0").select("poly_id", F.col("ring").alias("outer"))
    meets = crossed.filter("r1 = 0 AND r2 > 0").select("poly_id", F.col("r2").alias("ring_no"), F.lit(True).alias("meets_outer"))
    per = checks.join(own, ["poly_id", "ring_no"], "left").join(meets, ["poly_id", "ring_no"], "left").join(outer, "poly_id")
    first = F.get("ring", F.lit(0))
    outside = ~F.coalesce(G.point_in_ring(first["x"], first["y"], "outer"), F.lit(False))
    code = (
        F.when(F.col("ring_no") == 0, F.when(~F.col("valid"), "outer").when(F.col("crosses"), "outer_cross"))
        .when(~F.col("valid"), "hole").when(F.col("crosses"), "hole_cross")
        .when(outside, "hole_outside").when(F.col("meets_outer"), "hole_meets_outer")
    )
    ring_faults = per.select("poly_id", F.col("ring_no").alias("rank"), code.alias("error")).filter("error IS NOT NULL")
    # holes that cross each other, or lie one in the other
    hole_pairs = crossed.filter("r1 > 0 AND r1 < r2").select("poly_id")
    holes = rings.filter("ring_no > 0 AND size(ring) >= 3")
    starts = holes.select("poly_id", F.col("ring_no").alias("p_no"), first["x"].alias("px"), first["y"].alias("py"))
    shells = holes.select("poly_id", F.col("ring_no").alias("h_no"), F.col("ring").alias("outer"), F.array().cast(f"array<{G.RING}>").alias("holes"))
    nested = pairs_in_polygons(starts, shells, ["poly_id"], "px", "py").filter("p_no <> h_no").select("poly_id")
    joint = hole_pairs.unionByName(nested).distinct().select("poly_id", F.lit(2147483647).alias("rank"), F.lit("holes_meet").alias("error"))
    faults = ring_faults.unionByName(joint)
    return faults.groupBy("poly_id").agg(F.min(F.struct("rank", "error")).alias("b")).select("poly_id", "b.error")


def known_centers(places: DataFrame, centers: DataFrame) -> DataFrame:
    """The chosen point of each place and its candidates that are more than 1 m from
    an earlier one (by the order of listing)."""
    pts = places.filter("x IS NOT NULL").select("place_id", F.lit(-1).cast("bigint").alias("seq"), *POINT).unionByName(
        centers.filter("x IS NOT NULL").select("place_id", F.col("seq").cast("bigint").alias("seq"), *POINT)
    )
    # exact copies first: they need no distance
    spot = pts.groupBy("place_id", *POINT).agg(F.min("seq").alias("seq"))
    spot = cut_lineage(spot)
    left = spot.select("place_id", F.col("seq").alias("s1"), *[F.col(c).alias(f"l_{c}") for c in POINT])
    right = spot.select("place_id", F.col("seq").alias("s2"), *[F.col(c).alias(f"r_{c}") for c in POINT])
    close = near_pairs(left, right, rules.SAME_CENTER_M, ["place_id"]).filter("s2 < s1")
    gone = dropped_by_earlier(close.select("place_id", F.col("s1").alias("seq"), F.col("s2").alias("earlier")).distinct())
    return spot.join(gone, ["place_id", "seq"], "left_anti")


def dropped_by_earlier(close: DataFrame) -> DataFrame:
    """place_id, seq of rows dropped when rows are taken in order and one goes if a
    *kept* earlier row is close. ``close``: place_id, seq, earlier.

    Each round settles the rows whose earlier neighbours are all settled, the first of them at least; rows
    without close neighbours never enter, so the table shrinks fast.
    """
    open_edges = cut_lineage(close)
    dropped: DataFrame | None = None
    while not open_edges.isEmpty():
        later = open_edges.select("place_id", F.col("seq").alias("earlier")).distinct()
        kept = open_edges.select("place_id", "earlier").distinct().join(later, ["place_id", "earlier"], "left_anti")
        gone = cut_lineage(open_edges.join(kept, ["place_id", "earlier"], "left_semi").select("place_id", "seq").distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        as_earlier = gone.select("place_id", F.col("seq").alias("earlier"))
        open_edges = open_edges.join(gone, ["place_id", "seq"], "left_anti").join(as_earlier, ["place_id", "earlier"], "left_anti")
        open_edges = cut_lineage(open_edges)
    return close.select("place_id", "seq").limit(0) if dropped is None else dropped


def contained_other_places(polygons: DataFrame, all_centers: DataFrame, instances: DataFrame) -> DataFrame:
    """place_id, provider_key, external_key, others: how many other places have a
    center inside the group's polygons; rows of one instance count once.

    A center that is the only one of its instance in a zone adds one, so these are counted by tiles, without
    a row for each pair. Pairs are made of the centers of instances with more, and of groups whose polygons
    lie in several zones or have vertices missing.
    """
    keys = ["place_id", "provider_key", "external_key"]
    pts = all_centers.join(instances, "place_id").select(F.col("place_id").alias("other_id"), F.col("group_id").alias("other_group"), "lat", "lng").distinct()
    zoned = with_nearby_zones(pts).filter("other_id IS NOT NULL AND other_group IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    spot = F.struct("other_id", "x", "y")
    zoned = cut_lineage(zoned.groupBy("other_group", "utm_zone").agg(F.count(F.lit(1)).alias("n"), F.collect_list(spot).alias("spots")))
    first = F.get("spots", F.lit(0))
    alone = zoned.filter("n = 1").select("utm_zone", first["other_id"].alias("other_id"), first["x"].alias("x"), first["y"].alias("y"), F.lit(0).cast("bigint").alias("point_ref"))
    several = zoned.filter("n > 1").select("other_group", "utm_zone", F.inline("spots"))
    rings = T.rings_of()
    g = polygons.filter("place_id IS NOT NULL AND utm_zone IS NOT NULL").groupBy(*keys).agg(
        F.collect_list(F.struct("utm_zone", rings.alias("rings"), "outer", "holes")).alias("of"), F.bool_and(T.is_regular(rings)).alias("regular"),
        F.min("utm_zone").alias("utm_zone"), F.max("utm_zone").alias("last"),
    )
    g = g.select(*keys, "utm_zone", "of", (F.col("regular") & (F.col("utm_zone") == F.col("last"))).alias("plain"), F.monotonically_increasing_id().alias("shape_ref"))
    g = cut_lineage(T.with_box(g.withColumn("polygons", F.transform("of", lambda p: p["rings"]))))
    plain = g.filter("plain")
    counts = T.in_tiles(alone, plain, T.counted, "shape_ref bigint, n bigint").groupBy("shape_ref").agg(F.sum("n").alias("n"))
    # the place's own center is not another one
    own = plain.select("place_id", "utm_zone", "shape_ref", "of").join(alone.withColumnRenamed("other_id", "place_id"), ["place_id", "utm_zone"])
    own = own.filter(F.exists("of", lambda p: G.point_in_polygon("x", "y", p["outer"], p["holes"])))
    counts = counts.unionByName(own.groupBy("shape_ref").agg((-F.count(F.lit(1))).alias("n")))

    def paired(spots: DataFrame, groups: DataFrame) -> DataFrame:
        shapes = groups.select(F.col("place_id").alias("__own"), "shape_ref", F.inline("of")).drop("rings")
        hits = pairs_in_polygons(spots, shapes, ["utm_zone"]).filter("other_id <> __own")
        return hits.groupBy("shape_ref").agg(F.count_distinct("other_group").alias("n"))

    everyone = zoned.select("other_group", "utm_zone", F.inline("spots"))
    for spots, groups in ((several, plain), (everyone, g.filter("NOT plain"))):
        if not spots.isEmpty() and not groups.isEmpty():
            counts = counts.unionByName(paired(spots, groups))
    total = counts.groupBy("shape_ref").agg(F.sum("n").alias("others")).filter("others > 0")
    return g.select(*keys, "shape_ref").join(total, "shape_ref").drop("shape_ref")


def center_distances(polygons: DataFrame, centers: DataFrame) -> DataFrame:
    """place_id, provider_key, external_key, center_distance: least distance of a
    place's own centers to the group (0 inside). Centers in another zone are
    projected into the polygon's zone."""
    zones = polygons.select("place_id", F.col("utm_zone").alias("pz")).distinct()
    c = centers.join(zones, "place_id")
    c = reproject_zone(c.withColumn("__band", F.when(F.col("lat") < 0, "M").otherwise("N")), "pz", band="__band", stored_lat="lat", stored_lng="lng")
    c = c.select("place_id", "pz", F.col("rx").alias("px"), F.col("ry").alias("py"))
    shapes = polygons.select("place_id", "provider_key", "external_key", F.col("utm_zone").alias("pz"), "outer", "holes")
    j = skew_join(shapes, c, ["place_id", "pz"])
    inside = G.point_in_polygon("px", "py", "outer", "holes")
    d = F.when(inside, F.lit(0.0)).otherwise(G.boundary_distance("px", "py", "outer", "holes"))
    return j.groupBy("place_id", "provider_key", "external_key").agg(F.min(d).alias("center_distance"), F.bool_or(inside).alias("contains_center"))


def _number(v: Column) -> Column:
    t = F.regexp_replace(F.format_string("%.3f", v), r"\.?0+$", "")
    return F.when(t == "", "0").otherwise(t)


def score_polygons(polygons: DataFrame, places: DataFrame, centers: DataFrame, refs: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """One row per (place, provider, external id): measures, score, the two
    rejection flags and the reasons."""
    p = polygons.withColumns({"provider_key": low("provider"), "external_key": low("external_id")})
    p = cut_lineage(p.select(
        "poly_id", "place_id", "provider_key", "external_key", "priority", "utm_zone", "outer", "holes", "explicit_link"
    ))
    keys = ["place_id", "provider_key", "external_key"]
    broken = F.coalesce(F.size("outer") < 3, F.lit(True)) | F.coalesce(F.exists("holes", lambda h: F.coalesce(F.size(h) < 3, F.lit(True))), F.lit(False))
    marked = p.withColumn("broken", broken)
    errors = geometry_errors(marked.filter("NOT broken"))
    faulty = marked.join(errors, "poly_id", "left").groupBy(*keys).agg(
        F.bool_or("broken").alias("broken"), F.min(F.when(F.col("error").isNotNull(), F.struct("poly_id", "error"))).alias("e")
    )
    faulty = cut_lineage(faulty.select(*keys, F.when(F.col("broken"), "broken").otherwise(F.col("e.error")).alias("fault")))
    sound = p.join(faulty.filter("fault IS NULL").select(*keys), keys, "left_semi")
    holes = F.coalesce(F.aggregate("holes", F.lit(0), lambda acc, h: acc + F.size(h)), F.lit(0))
    measured = sound.groupBy(*keys).agg(
        F.sum(F.size("outer") + holes).alias("vertices"),
        (F.sum(G.net_area("outer", "holes")) / 1e6).alias("area_km2"),
        F.avg(G.compactness("outer", "holes")).alias("compactness"),
        F.bool_or(F.coalesce("explicit_link", F.lit(False))).alias("linked"),
        F.max("priority").alias("base"),
    )
    own_centers = cut_lineage(known_centers(places, centers))
    inst = same_instance_groups(places, place_names(places), refs) if instances is None else instances
    others = contained_other_places(sound, own_centers, inst)
    dist = center_distances(sound, own_centers)
    counts = own_centers.groupBy("place_id").agg(F.count(F.lit(1)).alias("known"))
    info = places.select("place_id", "place", F.col("x").isNotNull().alias("has_point"))
    j = (
        measured.join(dist, keys, "left").join(others, keys, "left").join(counts, "place_id", "left").join(info, "place_id", "left")
    )
    j = j.withColumns(
        {"contains_center": F.coalesce("contains_center", F.lit(False)), "others": F.coalesce("others", F.lit(0)), "known": F.coalesce("known", F.lit(0))}
    )
    accepted = ~F.col("contains_center") & F.col("linked") & F.coalesce(F.col("center_distance") <= rules.link_tolerance("place"), F.lit(False))
    j = j.withColumns({"accepted_by_link": accepted, "low": rules.least_area("place"), "high": rules.greatest_area("place")})
    area = F.col("area_km2")
    points = (
        F.col("base")
        + F.when(F.col("contains_center"), rules.CONTAINS_CENTER_POINTS).when(F.col("accepted_by_link"), rules.LINK_POINTS)
        .when(F.col("has_point"), rules.NO_CENTER_POINTS).otherwise(0)
        + F.least(F.lit(rules.VERTEX_POINTS_LIMIT), F.bround(F.log2(F.greatest(F.lit(2), F.col("vertices"))) * 2, 0).cast("int"))
        + F.when(area < F.col("low"), rules.SMALL_AREA_POINTS).when(area > F.col("high"), rules.LARGE_AREA_POINTS).otherwise(rules.AREA_POINTS)
        + F.when(F.col("compactness") >= rules.LEAST_COMPACTNESS, rules.COMPACT_POINTS).otherwise(rules.LOOSE_POINTS)
    )
    no_center = (F.col("known") > 0) & ~F.col("contains_center") & ~F.col("accepted_by_link")
    by_geometry = no_center | (area < F.col("low")) | (area > F.col("high"))
    by_others = F.col("others") >= rules.OTHERS_TO_REJECT
    reasons = F.concat_ws(
        "; ",
        F.when(no_center, rules.REASONS["no_center"]),
        F.when(area < F.col("low"), F.format_string(rules.REASONS["small"], _number(area), _number(F.col("low")))),
        F.when(area > F.col("high"), F.format_string(rules.REASONS["large"], _number(area), _number(F.col("high")))),
        F.when(by_others, F.format_string(rules.REASONS["others"], F.col("others"))),
    )
    scored = j.select(
        *keys, "vertices", "area_km2", "compactness", "contains_center", "center_distance", "accepted_by_link", "others",
        F.when(by_geometry | by_others, F.lit(REJECTED)).otherwise(points.cast("int")).alias("score"),
        by_others.alias("rejected_by_containment"), by_geometry.alias("rejected_by_geometry"), reasons.alias("rejection_reason"),
    )
    text = None
    for code, words in rules.REASONS.items():
        text = F.when(F.col("fault") == code, words) if text is None else text.when(F.col("fault") == code, words)
    bad = faulty.filter("fault IS NOT NULL").select(
        *keys, F.lit(0).cast("bigint").alias("vertices"), F.lit(0.0).alias("area_km2"), F.lit(0.0).alias("compactness"),
        F.lit(False).alias("contains_center"), F.lit(None).cast("double").alias("center_distance"), F.lit(False).alias("accepted_by_link"),
        F.lit(0).cast("bigint").alias("others"), F.lit(REJECTED).alias("score"), F.lit(False).alias("rejected_by_containment"),
        F.lit(True).alias("rejected_by_geometry"), text.alias("rejection_reason"),
    )
    return scored.unionByName(bad)


def reject_polygons(scored: DataFrame) -> DataFrame:
    """The rejected groups with their reasons."""
    return scored.filter("rejected_by_containment OR rejected_by_geometry")


def center_agreement(centers: DataFrame) -> DataFrame:
    """place_id, seq, agreement: +8 for each other center of the place within 3 km,
    -12 for each beyond 25 km.

    Centers at one spot are counted once with their number. Far ones are the total
    less those within 25 km. The spots of a place with at most ``FEW_SPOTS`` meet as they are, once
    each; in places with more only near spots ever meet, on a grid that repeats them.
    """
    c = centers.filter("x IS NOT NULL").select("place_id", "seq", *POINT)
    spot = c.groupBy("place_id", *POINT).agg(F.count(F.lit(1)).alias("n"))
    spot = cut_lineage(spot)
    total = cut_lineage(spot.groupBy("place_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("spots")))
    left = spot.select("place_id", *[F.col(k).alias(f"l_{k}") for k in POINT])
    right = spot.select("place_id", "n", *[F.col(k).alias(f"r_{k}") for k in POINT])
    few, many = total.filter(F.col("spots") <= FEW_SPOTS).select("place_id"), total.filter(F.col("spots") > FEW_SPOTS).select("place_id")
    met = left.filter("l_lat IS NOT NULL").join(few, "place_id").join(right, "place_id")
    met = met.withColumn("distance_m", projected_distance_m(point_side("l_"), point_side("r_"))).filter(F.col("distance_m") <= rules.DISAGREE_M)
    at = [F.col(f"l_{k}").alias(k) for k in POINT]

    def counted(near: DataFrame) -> DataFrame:
        return near.groupBy("place_id", *at).agg(
            F.sum(F.when(F.col("distance_m") <= rules.AGREE_M, F.col("n")).otherwise(0)).alias("agree"), F.sum("n").alias("within")
        )

    sums = counted(met)
    if not many.isEmpty():
        crowd = near_pairs(left.join(many, "place_id"), right.join(many, "place_id"), rules.DISAGREE_M, ["place_id"])
        sums = sums.unionByName(counted(crowd))
    s = sums.join(total, "place_id").select(
        "place_id", *POINT,
        ((F.col("agree") - 1) * rules.AGREE_POINTS + (F.col("total") - F.col("within")) * rules.DISAGREE_POINTS).cast("int").alias("agreement"),
    )
    return c.join(s, ["place_id", *POINT]).select("place_id", "seq", "agreement")


def score_centers(centers: DataFrame, places: DataFrame, chosen: DataFrame) -> DataFrame:
    """Centers with their score: priority, agreement, inside the chosen polygon, a
    real place node. ``chosen``: polygon rows of the preferred groups."""
    agree = center_agreement(centers)
    zoned = with_nearby_zones(centers.filter("x IS NOT NULL").select("place_id", "seq", "lat", "lng")).select("place_id", "seq", "utm_zone", "x", "y")
    inside = pairs_in_polygons(zoned, chosen.select("place_id", "utm_zone", "outer", "holes"), ["place_id", "utm_zone"])
    inside = inside.select("place_id", "seq").distinct().withColumn("__in", F.lit(True))
    node = places.select("place_id", (low("osm_type") == "node").alias("__node"), F.col("osm_id").alias("__osm"))
    j = centers.join(agree, ["place_id", "seq"], "left").join(inside, ["place_id", "seq"], "left").join(node, "place_id", "left")
    real = F.col("__node") & (F.col("__osm") > 0) & (low("provider") == rules.OSM.lower()) & (F.trim("external_id") == F.col("__osm").cast("string"))
    score = (
        F.col("priority") + F.coalesce("agreement", F.lit(0))
        + F.when(F.col("__in"), rules.CENTER_INSIDE_POINTS).otherwise(0)
        + F.when(F.coalesce(real, F.lit(False)), rules.PLACE_NODE_POINTS).otherwise(0)
    )
    return j.withColumn("score", score.cast("int")).drop("agreement", "__in", "__node", "__osm")


def choose_point(places: DataFrame, centers: DataFrame, scored: bool) -> DataFrame:
    """Places with the point of their preferred center, when they have one."""
    rank = effective_score() if scored else F.col("priority")
    best = first_match(centers.filter("x IS NOT NULL"), ["place_id"], [rank.desc(), F.col("updated_at").desc_nulls_last(), "seq"])
    b = best.select("place_id", *[F.col(c).alias(f"b_{c}") for c in POINT])
    j = places.join(b, "place_id", "left")
    has = F.col("b_x").isNotNull()
    return j.withColumns({c: F.when(has, F.col(f"b_{c}")).otherwise(F.col(c)) for c in POINT}).drop(*[f"b_{c}" for c in POINT])


def rescore(places: DataFrame, centers: DataFrame, polygons: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places with chosen point, scored centers, scored polygon groups)."""
    p0 = cut_lineage(choose_point(places, centers, scored=False))
    groups = cut_lineage(score_polygons(polygons, p0, centers, refs))
    keyed = polygons.withColumns({"provider_key": low("provider"), "external_key": low("external_id")})
    ok = groups.filter("NOT rejected_by_containment AND NOT rejected_by_geometry")
    latest = keyed.groupBy("place_id", "provider_key", "external_key").agg(F.max("updated_at").alias("u"), F.max("priority").alias("pr"))
    best = first_match(
        ok.join(latest, ["place_id", "provider_key", "external_key"]), ["place_id"],
        [F.col("score").desc(), F.col("u").desc_nulls_last(), F.col("pr").desc(), F.concat("provider_key", F.lit("\n"), "external_key")],
    )
    chosen = keyed.join(best.select("place_id", "provider_key", "external_key"), ["place_id", "provider_key", "external_key"])
    c1 = cut_lineage(score_centers(centers, p0, chosen))
    return choose_point(p0, c1, scored=True), c1, groups
