"""Upserts of place tables and whole-snapshot merges.

A snapshot is a :class:`Snapshot` of five tables. Incoming rows carry a negative
or separate id space; :func:`merge_snapshots` maps them to held places first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom import rules
from geoloom.functions.core import prefer_existing
from geoloom.operators.matching import find_matches, low, place_names
from geoloom.operators.ranking import first_match
from geoloom.session import cut_lineage

TEXTS = ("name", "place", "boundary", "admin_level", "country_code", "region", "district")


@dataclass(frozen=True)
class Snapshot:
    """places(place_id, TEXTS, osm_type, osm_id, x y utm_zone lat lng),
    aliases(place_id, seq, alias), refs(place_id, seq, provider, external_id,
    feature_type), centers(place_id, provider, external_id, priority, score,
    updated_at, point columns), polygons(place_id, provider, external_id, priority,
    updated_at, ring_text, holes_text, utm_zone, explicit_link)."""

    places: DataFrame
    aliases: DataFrame
    refs: DataFrame
    centers: DataFrame
    polygons: DataFrame


def _both(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Held rows as turn 0, incoming ones as turn 1."""
    return held.withColumn("__turn", F.lit(0)).unionByName(incoming.withColumn("__turn", F.lit(1)), allowMissingColumns=True)


def upsert_centers(held: DataFrame, incoming: DataFrame, order: str = "updated_at") -> DataFrame:
    """Key (place, provider, external id): the incoming row replaces the held one
    and its score starts anew. Equal times are settled by a hash of the row."""
    fresh = incoming.withColumn("score", F.lit(0))
    rows = _both(held, fresh).withColumns({"__k1": low("provider"), "__k2": low("external_id")})
    best = first_match(rows, ["place_id", "__k1", "__k2"], [F.col("__turn").desc(), F.col(order).desc_nulls_last(), F.xxhash64(*rows.columns)])
    return best.drop("__k1", "__k2", "__turn")


def upsert_polygons(held: DataFrame, incoming: DataFrame, order: str = "updated_at") -> DataFrame:
    """Key (place, ring text, provider): the link flag is OR-ed, blanks keep old
    values, id and priority come from the newest row, the score starts anew."""
    rows = _both(held, incoming).filter(F.trim("ring_text") != "").withColumns(
        {"__k1": F.lower("ring_text"), "__k2": low("provider")}
    )
    at = F.struct("__turn", F.col(order))

    def newest(c: str, when: Column | None = None) -> Column:
        return F.max_by(c, at if when is None else F.when(when, at)).alias(c)

    g = rows.groupBy("place_id", "__k1", "__k2").agg(
        F.min_by("ring_text", at).alias("ring_text"), F.min_by("provider", at).alias("provider"),
        newest("external_id"), newest("priority"), F.max(order).alias(order),
        newest("utm_zone", F.col("utm_zone") > 0),
        newest("boundary", F.trim("boundary") != ""), newest("admin_level", F.trim("admin_level") != ""),
        newest("holes_text", F.col("holes_text").isNotNull()),
        F.bool_or(F.coalesce("explicit_link", F.lit(False))).alias("explicit_link"),
        F.max("__turn").alias("__turn"), F.max_by("score", at).alias("__score"),
    )
    return g.withColumn("score", F.when(F.col("__turn") == 1, 0).otherwise(F.col("__score"))).drop("__k1", "__k2", "__turn", "__score")


def upsert_references(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Distinct (place, provider, external id, feature type), held spelling first."""
    rows = _both(held, incoming).withColumns({"__a": low("provider"), "__b": low("external_id"), "__c": low("feature_type")})
    best = first_match(rows.filter("__a <> '' AND __b <> ''"), ["place_id", "__a", "__b", "__c"], ["__turn", "seq"])
    return best.drop("__a", "__b", "__c", "__turn")


def merge_aliases(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Distinct aliases per place without regard to case, first spelling kept."""
    rows = _both(held, incoming).withColumn("alias", F.trim("alias")).filter("alias <> ''")
    best = rows.groupBy("place_id", F.lower("alias").alias("__k")).agg(F.min(F.struct("__turn", "seq", "alias")).alias("__b"))
    return best.select("place_id", F.col("__b.seq").alias("seq"), F.col("__b.alias").alias("alias"))


def merge_places(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Held texts stay, blanks are filled by the first incoming row that has one;
    a missing OSM id comes with its type. The point stays when there is one."""
    def first(c: str, ok: Column) -> Column:
        return F.min_by(c, F.when(ok, F.col("__in"))).alias(f"n_{c}")

    aggs = [first(c, F.trim(F.coalesce(F.col(c), F.lit(""))) != "") for c in TEXTS]
    osm = F.min_by(F.struct("osm_type", "osm_id"), F.when(F.col("osm_id") > 0, F.col("__in"))).alias("n_osm")
    point = F.min_by(F.struct("x", "y", "utm_zone", "lat", "lng"), F.when(F.col("x").isNotNull(), F.col("__in"))).alias("n_point")
    new = incoming.groupBy("place_id").agg(*aggs, osm, point)
    j = held.join(new, "place_id", "full_outer")
    cols = {c: prefer_existing(c, f"n_{c}") for c in TEXTS}
    has_osm = F.coalesce(F.col("osm_id") > 0, F.lit(False))
    cols["osm_type"] = F.when(has_osm, F.col("osm_type")).otherwise(F.coalesce("n_osm.osm_type", "osm_type", F.lit("")))
    cols["osm_id"] = F.when(has_osm, F.col("osm_id")).otherwise(F.coalesce("n_osm.osm_id", "osm_id", F.lit(0)))
    for c in ("x", "y", "utm_zone", "lat", "lng"):
        cols[c] = F.when(F.col("x").isNotNull(), F.col(c)).otherwise(F.col(f"n_point.{c}"))
    return j.select("place_id", *[v.alias(k) for k, v in cols.items()])


def _point_id(df: DataFrame) -> Column:
    short = lambda c: F.regexp_replace(F.format_string("%.3f", F.col(c)), r"\.?0+$", "")
    return F.concat(F.col("utm_zone").cast("string"), F.lit(":"), short("x"), F.lit(","), short("y"))


def normalize_snapshot(s: Snapshot, source: str = rules.LEGACY, zone: int = 0) -> Snapshot:
    """Fill blanks and derive what older snapshots lack: the name among the aliases,
    an OSM reference, a center candidate for a bare point, polygon zones and
    providers."""
    places = s.places.withColumns({c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in TEXTS}).withColumns(
        {"osm_type": F.coalesce("osm_type", F.lit("")), "osm_id": F.coalesce("osm_id", F.lit(0)),
         "utm_zone": F.when(F.coalesce(F.col("utm_zone"), F.lit(0)) > 0, F.col("utm_zone")).otherwise(F.when(F.col("x").isNotNull(), F.lit(zone)))}
    )
    provider = F.when(F.col("osm_id") > 0, F.lit(rules.OSM)).otherwise(F.lit(source))
    own_id = F.when(F.col("osm_id") > 0, F.col("osm_id").cast("string"))
    named = places.select("place_id", F.lit(1_000_000).alias("seq"), F.col("name").alias("alias"))
    osm_refs = places.filter("osm_id > 0").select(
        "place_id", F.lit(1_000_000).alias("seq"), F.lit(rules.OSM).alias("provider"), own_id.alias("external_id"),
        F.col("osm_type").alias("feature_type"),
    )
    bare = places.filter("x IS NOT NULL").join(s.centers.select("place_id"), "place_id", "left_anti")
    centers = bare.select(
        "place_id", provider.alias("provider"), F.coalesce(own_id, _point_id(bare)).alias("external_id"),
        rules.source_priority(provider).alias("priority"), F.lit(0).alias("score"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        "x", "y", "utm_zone", "lat", "lng",
    )
    polygons = s.polygons.join(
        places.select("place_id", provider.alias("__p"), F.coalesce(own_id, F.lit("")).alias("__e")), "place_id", "left"
    )
    polygons = polygons.withColumns(
        {
            "provider": F.coalesce(F.when(F.trim("provider") != "", F.col("provider")), "__p"),
            "external_id": F.coalesce("external_id", "__e"),
            "utm_zone": F.when(F.coalesce(F.col("utm_zone"), F.lit(0)) > 0, F.col("utm_zone")).otherwise(F.lit(zone)),
            "explicit_link": F.coalesce("explicit_link", F.lit(False)),
        }
    ).drop("__p", "__e")
    return Snapshot(
        places, merge_aliases(s.aliases, named), upsert_references(s.refs, osm_refs),
        s.centers.unionByName(centers), polygons,
    )


def _mapped(df: DataFrame, mapping: DataFrame) -> DataFrame:
    return df.join(mapping, df.place_id == mapping.incoming_id).drop("place_id", "incoming_id").withColumnRenamed("target_id", "place_id")


def map_incoming(held: Snapshot, incoming: Snapshot) -> DataFrame:
    """incoming_id, target_id: the matched held place, or a new id for the rest
    (``-1 - incoming id``; rows of one reference or OSM id share the least)."""
    from geoloom.operators.matching import ref_keys
    from geoloom.operators.proximity import connected_groups, star_edges

    names = place_names(incoming.places, incoming.aliases.select("place_id", "alias"))
    found = find_matches(
        incoming.places, names, incoming.refs, held.places, place_names(held.places, held.aliases.select("place_id", "alias")), held.refs
    )
    found = cut_lineage(found.select("incoming_id", "place_id"))
    ids = incoming.places.select(F.col("place_id").alias("incoming_id"))
    rest = ids.join(found, "incoming_id", "left_anti").withColumnRenamed("incoming_id", "place_id")
    loose = incoming.places.join(rest, "place_id", "left_semi")
    by_id = star_edges(loose.filter("osm_id > 0").select("place_id", "osm_id", low("osm_type").alias("kind")), "place_id", ["osm_id", "kind"])
    refs = ref_keys(incoming.refs.join(rest, "place_id", "left_semi")).select("place_id", "k1", "k2", "k3").distinct()
    edges = by_id.unionByName(star_edges(refs, "place_id", ["k1", "k2", "k3"]))
    groups = connected_groups(rest, edges, "place_id", "root")
    fresh = groups.select(F.col("place_id").alias("incoming_id"), (F.lit(-1) - F.col("root")).alias("target_id"))
    return cut_lineage(found.select("incoming_id", F.col("place_id").alias("target_id")).unionByName(fresh))


def merge_snapshots(held: Snapshot, incoming: Snapshot, mapping: DataFrame | None = None) -> Snapshot:
    """Held with incoming: match, fill blanks, unite names, references and
    candidates. Scores are left to the quality stage."""
    m = map_incoming(held, incoming) if mapping is None else mapping
    places = _mapped(incoming.places.withColumn("__in", F.col("place_id")), m)
    names = _mapped(incoming.places, m).select("place_id", F.lit(2_000_000).alias("seq"), F.col("name").alias("alias"))
    bare = incoming.places.filter("x IS NOT NULL").join(incoming.centers.select("place_id"), "place_id", "left_anti")
    legacy = bare.select(
        "place_id", F.lit(rules.LEGACY).alias("provider"), _point_id(bare).alias("external_id"),
        F.lit(rules.LEGACY_PRIORITY).alias("priority"), F.lit(0).alias("score"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        "x", "y", "utm_zone", "lat", "lng",
    )
    return Snapshot(
        merge_places(held.places, places),
        merge_aliases(
            held.aliases.unionByName(held.places.select("place_id", F.lit(1_000_000).alias("seq"), F.col("name").alias("alias"))),
            _mapped(incoming.aliases, m).unionByName(names),
        ),
        upsert_references(held.refs, _mapped(incoming.refs, m)),
        upsert_centers(held.centers, _mapped(incoming.centers.unionByName(legacy), m)),
        upsert_polygons(held.polygons, _mapped(incoming.polygons, m)),
    )


def _without(candidates: DataFrame, touched: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Candidates but those of the named providers at touched places."""
    keys = [p.lower() for p in providers]
    gone = low("provider").isin(*keys) if keys else F.lit(False)
    stay = candidates.filter(~gone)
    kept = candidates.filter(gone).join(touched, "place_id", "left_anti")
    return stay.unionByName(kept)


def merge_replacing(held: Snapshot, incoming: Snapshot, providers: Sequence[str], mapping: DataFrame | None = None) -> Snapshot:
    """As :func:`merge_snapshots`, but at matched places the named providers' centers
    and polygons are replaced by the incoming ones."""
    m = map_incoming(held, incoming) if mapping is None else mapping
    touched = m.select(F.col("target_id").alias("place_id")).distinct()
    cleared = replace(
        held, centers=_without(held.centers, touched, providers), polygons=_without(held.polygons, touched, providers)
    )
    return merge_snapshots(cleared, incoming, m)


def restore_provider(before: DataFrame, after: DataFrame, outcomes: DataFrame, provider: str) -> DataFrame:
    """Polygons after a refresh. ``outcomes``: place_id, transient, received. Where a
    place got no usable new polygon of the provider, a transient failure brings its
    old ones back and a definite empty answer removes what is left."""
    own = low("provider") == provider.lower()
    got = after.filter(own & ~F.coalesce(F.col("rejected"), F.lit(False))).select("place_id").distinct()
    empty = outcomes.join(got, "place_id", "left_anti")
    back = before.filter(own).join(empty.filter("transient").select("place_id"), "place_id", "left_semi")
    drop = empty.filter("NOT transient AND NOT received").select("place_id")
    kept = after.filter(~own).unionByName(after.filter(own).join(drop, "place_id", "left_anti"))
    restored = kept.unionByName(back)
    return restored.dropDuplicates(["place_id", "provider", "ring_text"])


def copy_existing(fresh: Snapshot, previous: Snapshot, matches: DataFrame, excluded: str | None = None) -> Snapshot:
    """Carry aliases, context and candidates of the previous row to its match.
    ``matches``: incoming_id (fresh place), place_id (previous place)."""
    # a previous place may be carried to several fresh ones
    to_fresh = matches.select(F.col("place_id").alias("old_id"), F.col("incoming_id").alias("target_id"))

    def carried(df: DataFrame) -> DataFrame:
        d = df if excluded is None or "provider" not in df.columns else df.filter(low("provider") != excluded.lower())
        return d.join(to_fresh, d.place_id == to_fresh.old_id).drop("place_id", "old_id").withColumnRenamed("target_id", "place_id")

    old = carried(previous.places).withColumn("__in", F.col("place_id"))
    kept = ("boundary", "admin_level", "region", "district")
    blanks = old.withColumns({c: F.lit("") for c in TEXTS if c not in kept}).withColumns(
        {"osm_id": F.lit(0).cast("bigint"), **({} if excluded is None else {"x": F.lit(None).cast("double")})}
    )
    return Snapshot(
        merge_places(fresh.places, blanks),
        merge_aliases(fresh.aliases, carried(previous.aliases)),
        upsert_references(fresh.refs, carried(previous.refs)),
        # what the fresh row has itself wins over what is carried along
        upsert_centers(carried(previous.centers), fresh.centers),
        upsert_polygons(carried(previous.polygons), fresh.polygons),
    )


def stale_geometry_keys(shown: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys shown before but not wanted now."""
    return shown.select("place_key", "geometry_key").join(wanted.select("place_key", "geometry_key"), ["place_key", "geometry_key"], "left_anti")


def prune_missing_provider(polygons: DataFrame, listed: DataFrame, provider: str) -> DataFrame:
    """After a complete listing, places that were not listed lose the provider's
    polygons."""
    own = low("provider") == provider.lower()
    return polygons.filter(~own).unionByName(polygons.filter(own).join(listed.select("place_id"), "place_id", "left_semi"))


def has_provider_polygon(places: DataFrame, polygons: DataFrame, provider: str) -> DataFrame:
    from geoloom.operators.ranking import usable_candidate

    own = polygons.filter(usable_candidate() & (low("provider") == provider.lower()))
    return places.join(own.select("place_id"), "place_id", "left_semi")
