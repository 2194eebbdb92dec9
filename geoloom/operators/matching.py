"""Finding the held place of an incoming row.

Tables: places (place_id, name, place, region, district, osm_type, osm_id and the
point columns), names (place_id, name_key) and refs (place_id, seq, provider,
external_id, feature_type). All text keys are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom import rules
from geoloom.functions.text import normalize_name
from geoloom.functions.geodesy import projected_distance_m
from geoloom.operators.proximity import near_pairs, point_columns, point_side
from geoloom.operators.routes import nearest_two
from geoloom.operators.skew import skew_join
from geoloom.session import cut_lineage


def low(c: str) -> Column:
    return F.lower(F.coalesce(F.trim(F.col(c)), F.lit("")))


def place_names(places: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Distinct normalized names and aliases."""
    n = places.select("place_id", normalize_name("name").alias("name_key"))
    if aliases is not None:
        n = n.unionByName(aliases.select("place_id", normalize_name("alias").alias("name_key")))
    return n.filter("name_key <> ''").distinct()


def ref_keys(refs: DataFrame) -> DataFrame:
    """OSM ids also need the same feature type: node, way and relation ids overlap."""
    osm = low("provider") == rules.OSM.lower()
    return refs.withColumns(
        {"k1": low("provider"), "k2": low("external_id"), "k3": F.when(osm, low("feature_type")).otherwise("")}
    ).filter("k1 <> '' AND k2 <> ''")


def match_by_reference(incoming_refs: DataFrame, held_refs: DataFrame) -> DataFrame:
    """incoming_id, place_id: the first reference (by seq) that is held."""
    held = ref_keys(held_refs).groupBy("k1", "k2", "k3").agg(F.min("place_id").alias("held_id"))
    mine = ref_keys(incoming_refs).select(F.col("place_id").alias("incoming_id"), "seq", "k1", "k2", "k3")
    hits = skew_join(mine, held, ["k1", "k2", "k3"])
    best = hits.groupBy("incoming_id").agg(F.min(F.struct("seq", "held_id")).alias("b"))
    return best.select("incoming_id", F.col("b.held_id").alias("place_id"))


def match_by_osm_id(incoming: DataFrame, held: DataFrame) -> DataFrame:
    h = held.filter("osm_id > 0").groupBy("osm_id", low("osm_type").alias("kind")).agg(F.min("place_id").alias("held_id"))
    m = incoming.filter("osm_id > 0").select(F.col("place_id").alias("incoming_id"), "osm_id", low("osm_type").alias("kind"))
    return skew_join(m, h, ["osm_id", "kind"]).select("incoming_id", F.col("held_id").alias("place_id"))


def match_by_name(incoming_names: DataFrame, held_names: DataFrame) -> DataFrame:
    """incoming_id, name_key, holders, first_id: how many held places share each
    name. Counts instead of pairs, so one very common name stays one row."""
    h = held_names.groupBy("name_key").agg(F.count(F.lit(1)).alias("holders"), F.min("place_id").alias("first_id"))
    return skew_join(incoming_names.withColumnRenamed("place_id", "incoming_id"), h, ["name_key"])


def _context(df: DataFrame) -> DataFrame:
    return df.withColumns({"c1": low("region"), "c2": low("district"), "c3": low("place")})


def match_by_context(incoming: DataFrame, incoming_names: DataFrame, held: DataFrame, held_names: DataFrame) -> DataFrame:
    """incoming_id, place_id where exactly one namesake has the same region,
    district and class (region or district not blank)."""
    ctx = _context(held).filter("c1 <> '' OR c2 <> ''").select("place_id", "c1", "c2", "c3")
    h = held_names.join(ctx, "place_id").groupBy("name_key", "c1", "c2", "c3").agg(
        F.min("place_id").alias("lo"), F.max("place_id").alias("hi")
    )
    m = incoming_names.join(_context(incoming).select("place_id", "c1", "c2", "c3"), "place_id")
    hits = skew_join(m.withColumnRenamed("place_id", "incoming_id"), h, ["name_key", "c1", "c2", "c3"])
    one = hits.groupBy("incoming_id").agg(F.min("lo").alias("place_id"), F.max("hi").alias("hi"))
    return one.filter("place_id = hi").select("incoming_id", "place_id")


def _locations(held: DataFrame, held_names: DataFrame) -> DataFrame:
    """Held names by location: rows at one spot count as one with least and
    greatest id, so copies do not multiply pairs."""
    h = point_columns(held.filter("x IS NOT NULL"), "r_", ["place_id", low("place").alias("r_place")])
    return held_names.join(h, "place_id").groupBy(
        "name_key", "r_place", "r_x", "r_y", "r_utm_zone", "r_lat", "r_lng"
    ).agg(F.min("place_id").alias("lo"), F.max("place_id").alias("hi"))


def _nearest_namesakes(
    incoming: DataFrame, incoming_names: DataFrame, held: DataFrame, held_names: DataFrame, fits: Column, keep: DataFrame | None = None
) -> DataFrame:
    """The nearest namesake within reach: incoming_id, place, its location's least and greatest id, distance_m,
    and second_distance_m of the next location. ``fits`` tells over ``place``, ``r_place`` and the columns
    of ``keep`` (incoming_id; left join) which classes compete; a null counts as false.

    Namesakes of a row may be very many, so their pairs are never kept: a first pass over
    them takes the least distance and its location, a second one the ids there and the
    next distance. Both are aggregates of numbers, reduced in the task that meets the pairs.
    """
    m = point_columns(incoming.filter("x IS NOT NULL"), "l_", ["place_id", "place"]).join(incoming_names, "place_id")
    m = m.withColumnRenamed("place_id", "incoming_id")
    if keep is not None:
        m = m.join(keep, "incoming_id", "left")
    m, spots = cut_lineage(m), cut_lineage(_locations(held, held_names))
    reach = rules.MAX_IDENTITY_M + rules.CLEAR_LEAD_M
    spot = F.xxhash64("r_place", "r_x", "r_y", "r_utm_zone")
    d, lo, hi = F.col("distance_m"), F.col("lo"), F.col("hi")
    first = near_pairs(m, spots, reach, ["name_key"]).filter(fits).groupBy("incoming_id").agg(
        F.min(d).alias("__d1"), F.min_by(spot, d).alias("__at")
    )
    again = near_pairs(m.join(cut_lineage(first), "incoming_id"), spots, reach, ["name_key"]).filter(fits)
    here, kind = d == F.col("__d1"), F.xxhash64("place")
    own = here | (spot == F.col("__at"))
    found = again.groupBy("incoming_id").agg(
        F.min("__d1").alias("distance_m"), F.min(F.when(own, lo)).alias("lo"), F.max(F.when(own, hi)).alias("hi"),
        F.min(F.when(here, spot)).alias("s0"), F.max(F.when(here, spot)).alias("s1"),
        F.min(F.when(here, kind)).alias("k0"), F.max(F.when(here, kind)).alias("k1"),
        F.min(F.when(spot != F.col("__at"), d)).alias("further"),
    )
    tie = (F.col("s0") != F.col("s1")) | (F.col("k0") != F.col("k1"))
    found = found.withColumn("second_distance_m", F.when(tie, d).otherwise(F.col("further")))
    # rows that share an id: the class is that of the one which is nearest
    classes = m.select("incoming_id", "place", kind.alias("k0")).distinct()
    return found.join(classes, ["incoming_id", "k0"]).select("incoming_id", "place", "lo", "hi", "distance_m", "second_distance_m")


def accept_nearest(pairs: DataFrame, clear_lead: bool = True) -> DataFrame:
    """The nearest within the limit of the row's class; alone, on the spot or
    clearly ahead of the second."""
    return _accepted(nearest_two(pairs, ["incoming_id"], "distance_m", ["lo"]), clear_lead)


def _accepted(n: DataFrame, clear_lead: bool = True) -> DataFrame:
    second = F.when(F.col("lo") < F.col("hi"), F.col("distance_m")).otherwise(F.col("second_distance_m"))
    ok = F.col("distance_m") <= rules.identity_distance("place")
    if clear_lead:
        ok &= (
            second.isNull()
            | (F.col("distance_m") <= rules.SAME_SPOT_M)
            | (second - F.col("distance_m") >= rules.CLEAR_LEAD_M)
        )
    return n.filter(ok).select("incoming_id", F.col("lo").alias("place_id"), "distance_m")


def prefer_same_class(incoming: DataFrame, incoming_names: DataFrame, held: DataFrame, held_names: DataFrame) -> DataFrame:
    """incoming_id of rows that have a namesake of their own class anywhere."""
    h = held_names.join(held.select("place_id", low("place").alias("c3")), "place_id").select("name_key", "c3").distinct()
    m = incoming_names.join(incoming.select("place_id", low("place").alias("c3")).filter("c3 <> ''"), "place_id")
    return skew_join(m, h, ["name_key", "c3"]).select(F.col("place_id").alias("incoming_id")).distinct()


def match_nearest_unambiguous(
    incoming: DataFrame, incoming_names: DataFrame, held: DataFrame, held_names: DataFrame
) -> DataFrame:
    """Name stage for rows with a point: own class first, then a sole match of the
    context, else the nearest clear namesake."""
    same = prefer_same_class(incoming, incoming_names, held, held_names).withColumn("__same", F.lit(True))
    sole = cut_lineage(match_by_context(incoming, incoming_names, held, held_names))
    # a sole context match competes alone, at its own distance
    fixed = point_columns(held.filter("x IS NOT NULL"), "r_", ["place_id"]).join(sole, "place_id")
    fixed = fixed.join(
        point_columns(incoming.filter("x IS NOT NULL"), "l_", [F.col("place_id").alias("incoming_id"), "place"]), "incoming_id"
    )
    alone = fixed.select(
        "incoming_id", "place", F.col("place_id").alias("lo"), F.col("place_id").alias("hi"),
        projected_distance_m(point_side("l_"), point_side("r_")).alias("distance_m"),
    )
    fits = F.col("__same").isNull() | (low("place") == F.col("r_place"))
    unsettled = incoming.join(sole.select(F.col("incoming_id").alias("place_id")), "place_id", "left_anti")
    nearest = _nearest_namesakes(unsettled, incoming_names, held, held_names, fits, same)
    return _accepted(nearest).unionByName(accept_nearest(alone))


def find_matches(
    incoming: DataFrame, incoming_names: DataFrame, incoming_refs: DataFrame,
    held: DataFrame, held_names: DataFrame, held_refs: DataFrame,
) -> DataFrame:
    """The whole cascade: reference, OSM id, name with point, name with context.
    Columns incoming_id, place_id, stage."""
    a = match_by_reference(incoming_refs, held_refs).withColumn("stage", F.lit(1))
    b = match_by_osm_id(incoming, held).withColumn("stage", F.lit(2))
    c = match_nearest_unambiguous(incoming, incoming_names, held, held_names).drop("distance_m").withColumn("stage", F.lit(3))
    no_point = incoming.filter("x IS NULL")
    d = match_by_context(no_point, incoming_names.join(no_point.select("place_id"), "place_id", "left_semi"), held, held_names)
    found = a.unionByName(b).unionByName(c).unionByName(d.withColumn("stage", F.lit(4)))
    # one pass picks the earliest stage instead of an anti-join between stages
    best = found.groupBy("incoming_id").agg(F.min(F.struct("stage", "place_id")).alias("b"))
    return best.select("incoming_id", "b.place_id", "b.stage")


def find_existing(incoming: DataFrame, incoming_names: DataFrame, held: DataFrame, held_names: DataFrame) -> DataFrame:
    """Previous row of a place: same OSM id, else the nearest namesake of a
    compatible class within the limit."""
    a = match_by_osm_id(incoming, held).withColumn("stage", F.lit(1))
    fits = (low("place") == "") | (F.col("r_place") == "") | (low("place") == F.col("r_place"))
    b = _accepted(_nearest_namesakes(incoming, incoming_names, held, held_names, fits), clear_lead=False).select("incoming_id", "place_id", F.lit(2).alias("stage"))
    best = a.unionByName(b).groupBy("incoming_id").agg(F.min(F.struct("stage", "place_id")).alias("b"))
    return best.select("incoming_id", "b.place_id", "b.stage")


def explicit_link(relations: DataFrame, label_nodes: DataFrame, places: DataFrame, refs: DataFrame) -> DataFrame:
    """relation_id, place_id pairs: the place is the relation, or one of its label
    nodes (by own id or by an OSM node reference)."""
    own = places.filter(low("osm_type") == "relation").select("place_id", F.col("osm_id").alias("relation_id"))
    by_relation = relations.select("relation_id").join(own, "relation_id")
    node_ids = places.filter((low("osm_type") == "node") & (F.col("osm_id") > 0)).select("place_id", F.col("osm_id").alias("node_id"))
    ref_nodes = refs.filter((low("provider") == rules.OSM.lower()) & (low("feature_type") == "node")).select(
        "place_id", F.col("external_id").try_cast("bigint").alias("node_id")
    )
    by_node = skew_join(label_nodes, node_ids.unionByName(ref_nodes).distinct(), ["node_id"]).select("relation_id", "place_id")
    return by_relation.select("relation_id", "place_id").unionByName(by_node).distinct()


def link_relations(
    relations: DataFrame, relation_names: DataFrame, label_nodes: DataFrame,
    places: DataFrame, names: DataFrame, refs: DataFrame,
) -> DataFrame:
    """relation_id, place_id, stage: name overlap with a sole explicit link (1), or
    the nearest clear namesake (2), explicit links and own class first."""
    linked = explicit_link(relations, label_nodes, places, refs)
    shared = linked.join(relation_names, "relation_id").join(names, ["place_id", "name_key"]).select("relation_id", "place_id").distinct()
    shared = cut_lineage(shared)
    counts = shared.groupBy("relation_id").agg(F.count(F.lit(1)).alias("n"), F.min("place_id").alias("place_id"))
    sole = counts.filter("n = 1").select("relation_id", "place_id", F.lit(1).alias("stage"))
    several = shared.join(counts.filter("n > 1").select("relation_id"), "relation_id", "left_semi")

    open_rel = relations.join(sole.select("relation_id"), "relation_id", "left_anti").filter("x IS NOT NULL")
    plain = cut_lineage(open_rel.join(several.select("relation_id").distinct(), "relation_id", "left_anti"))

    def as_places(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("relation_id", "place_id")

    near = match_nearest_unambiguous(
        as_places(plain), as_places(relation_names.join(plain.select("relation_id"), "relation_id", "left_semi")), places, names
    ).select(F.col("incoming_id").alias("relation_id"), "place_id", F.lit(2).alias("stage"))
    # several explicit links: the nearest clear one among them
    among = several.join(point_columns(places.filter("x IS NOT NULL"), "r_", ["place_id"]), "place_id").join(
        point_columns(open_rel, "l_", ["relation_id", "place"]), "relation_id"
    )
    among = among.select(
        F.col("relation_id").alias("incoming_id"), "place", F.col("place_id").alias("lo"), F.col("place_id").alias("hi"),
        projected_distance_m(point_side("l_"), point_side("r_")).alias("distance_m"),
    )
    chosen = accept_nearest(among).select(F.col("incoming_id").alias("relation_id"), "place_id", F.lit(1).alias("stage"))
    return sole.unionByName(chosen).unionByName(near)


def attach_residential(areas: DataFrame, places: DataFrame) -> DataFrame:
    """area_id, place_id: nearest place of the same name at any distance, else the
    nearest place within 8 km. Areas are at lat, lng; places have x, y in one zone per row,
    and every zone that holds places is searched."""
    from geoloom.operators.spatial import nearest_segments, with_zones_in_use, zone_bounds

    p = places.filter("x IS NOT NULL").select(
        "place_id", normalize_name("name").alias("name_key"), "utm_zone",
        F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"),
    )
    used = zone_bounds(p, F.col("ax"), F.col("ay"), F.col("ax"), F.col("ay"))
    a = with_zones_in_use(areas.select("area_id", normalize_name("name").alias("name_key"), "lat", "lng"), used)
    a = a.select("area_id", "name_key", "utm_zone", "x", "y")
    named = nearest_segments(a.filter("name_key <> ''"), p.filter("name_key <> ''"), "area_id", ["place_id"], ["name_key", "utm_zone"])
    rest = a.join(named.select("area_id"), "area_id", "left_anti")
    near = nearest_segments(rest, p, "area_id", ["place_id"], ["utm_zone"], max_distance=rules.RESIDENTIAL_LIMIT_M)
    return named.select("area_id", "place_id").unionByName(near.select("area_id", "place_id"))


def same_instance_groups(places: DataFrame, names: DataFrame, refs: DataFrame) -> DataFrame:
    """place_id, group_id: rows that are one place by OSM id, shared reference, or
    a common name and compatible class within 100 m."""
    from geoloom.operators.proximity import connected_groups, star_edges

    by_id = star_edges(places.filter("osm_id > 0").select("place_id", "osm_id", low("osm_type").alias("kind")), "place_id", ["osm_id", "kind"])
    by_ref = star_edges(ref_keys(refs).select("place_id", "k1", "k2", "k3").distinct(), "place_id", ["k1", "k2", "k3"])
    spots = _locations(places, names)
    left = spots.select(
        "name_key", F.col("r_place").alias("l_place"), *[F.col(f"r_{c}").alias(f"l_{c}") for c in ("x", "y", "utm_zone", "lat", "lng")],
        F.col("lo").alias("a"),
    )
    pairs = near_pairs(left, spots.withColumnRenamed("lo", "b"), rules.SAME_INSTANCE_M, ["name_key"])
    fits = (F.col("l_place") == "") | (F.col("r_place") == "") | (F.col("l_place") == F.col("r_place"))
    by_spot = pairs.filter(fits & (F.col("a") > F.col("b"))).select("a", "b")
    # rows at one spot with one name and class belong together as well
    at_spot = names.join(
        places.filter("x IS NOT NULL").select("place_id", low("place").alias("c3"), "x", "y", "utm_zone"), "place_id"
    )
    stack = star_edges(at_spot, "place_id", ["name_key", "c3", "x", "y", "utm_zone"])
    edges = by_id.unionByName(by_ref).unionByName(by_spot).unionByName(stack)
    return connected_groups(places.select("place_id"), edges, "place_id", "group_id")
