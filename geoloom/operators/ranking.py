"""Picking one row per group: first, best and preferred candidates.

Picks are ``row_number`` limits or min/max aggregates; both keep only one row
per group and task before the shuffle, so a hot group costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.core import ColumnOrName, col
from geoloom.functions.text import normalize_name

REJECTED = -2147483648


def first_match(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def dedupe_first(df: DataFrame, key: Column, order: Sequence[str | Column], valid: Column | None = None) -> DataFrame:
    """First row per key without regard to case; rows outside ``valid`` go."""
    d = df if valid is None else df.filter(valid)
    return first_match(d.withColumn("__key", F.lower(key)), ["__key"], order).drop("__key")


def place_key(osm_type="osm_type", osm_id="osm_id", name="name", place="place") -> Column:
    return F.when(col(osm_id) > 0, F.concat_ws(":", col(osm_type), col(osm_id))).otherwise(
        F.concat_ws(":", col(name), col(place))
    )


def area_key(osm_type="osm_type", osm_id="osm_id", name="name", x="x", y="y") -> Column:
    rounded = [F.format_string("%.0f", col(c)) for c in (x, y)]
    return F.when(col(osm_id) > 0, F.concat_ws(":", col(osm_type), col(osm_id))).otherwise(
        F.concat_ws(":", col(name), *rounded)
    )


def usable_candidate(text="ring_text", by_guard="rejected_by_containment", by_geometry="rejected_by_geometry") -> Column:
    present = F.coalesce(F.trim(col(text)) != "", F.lit(False))
    return present & ~F.coalesce(col(by_guard), F.lit(False)) & ~F.coalesce(col(by_geometry), F.lit(False))


def effective_score(score="score", priority="priority", rejected: Column | None = None) -> Column:
    s = F.when(col(score) != 0, col(score)).otherwise(col(priority))
    return s if rejected is None else F.when(rejected, F.lit(REJECTED)).otherwise(s)


def candidate_groups(df: DataFrame, entity: str = "place_id", members: str | None = None) -> DataFrame:
    """Per provider and external id: best score, latest time, top priority, count."""
    aggs = [
        F.max(effective_score()).alias("group_score"),
        F.max("updated_at").alias("group_updated"),
        F.max("priority").alias("group_priority"),
        F.count(F.lit(1)).alias("members"),
    ]
    return df.groupBy(
        entity, F.lower("provider").alias("provider_key"), F.lower("external_id").alias("external_key")
    ).agg(*aggs)


def preferred_group(df: DataFrame, entity: str = "place_id") -> DataFrame:
    """The chosen (provider, external id) of each place among usable candidates."""
    g = candidate_groups(df.filter(usable_candidate()), entity)
    return first_match(
        g,
        [entity],
        [F.col("group_score").desc(), F.col("group_updated").desc(), F.col("group_priority").desc(),
         F.concat("provider_key", F.lit("\n"), "external_key")],
    )


def preferred_polygon(df: DataFrame, entity: str = "place_id") -> DataFrame:
    """All candidate rows of the chosen group of each place."""
    g = preferred_group(df, entity).select(entity, "provider_key", "external_key")
    keyed = df.filter(usable_candidate()).withColumns(
        {"provider_key": F.lower("provider"), "external_key": F.lower("external_id")}
    )
    return keyed.join(g, [entity, "provider_key", "external_key"]).drop("provider_key", "external_key")


def preferred_rings(candidates: DataFrame, raw: DataFrame, entity: str = "place_id", text: str = "ring_text") -> DataFrame:
    """Ring texts to show: those of the chosen group; the raw list only for places
    that have no candidate rows at all."""
    chosen = preferred_polygon(candidates, entity).select(entity, text)
    fallback = raw.filter(F.trim(text) != "").join(candidates.select(entity), entity, "left_anti").select(entity, text)
    both = chosen.unionByName(fallback)
    return both.groupBy(entity, F.lower(text).alias("__t")).agg(F.min(text).alias(text)).drop("__t")


def preferred_center(df: DataFrame, entity: str = "place_id", tie: Sequence[str] = ("seq",), scored: bool = True) -> DataFrame:
    score = effective_score() if scored else F.col("priority")
    return first_match(df, [entity], [score.desc(), F.col("updated_at").desc(), *tie])


def preferred_rejection(df: DataFrame, entity: str = "place_id", tie: Sequence[str] = ("seq",)) -> DataFrame:
    bad = (F.col("rejected_by_containment") | F.col("rejected_by_geometry")) & (F.trim("rejection_reason") != "")
    best = first_match(df.filter(bad), [entity], [F.col("priority").desc(), F.col("updated_at").desc(), *tie])
    return best.select(entity, "rejection_reason")


def first_usable_relation(df: DataFrame, entity: str = "place_id", order: str = "listing") -> DataFrame:
    """First relation candidate in listing order that survived rejection."""
    return first_match(df.filter(~F.col("rejected")), [entity], [order])


def order_places(df: DataFrame, *tie: str) -> DataFrame:
    return df.orderBy(F.lower("name"), F.lower("place"), *tie)


def shuffle_rows(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """A random order that a retried task repeats: by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), *key)


def feature_score(
    distance: ColumnOrName, id_hit: ColumnOrName, target: ColumnOrName, place: ColumnOrName,
    name: ColumnOrName, city: ColumnOrName, formatted: ColumnOrName, categories: ColumnOrName,
) -> Column:
    """Points for how well an answered feature fits a place."""
    t, cats = normalize_name(target), F.lower(F.coalesce(col(categories), F.lit("")))
    d, cls = col(distance), F.lower(F.trim(F.coalesce(col(place), F.lit(""))))
    kinds = [cats.contains(f"administrative.{k}") for k in ("city", "town", "village", "hamlet")]
    settlement = kinds[0] | kinds[1] | kinds[2] | kinds[3]
    return (
        F.when(d <= 3000, 100).when(d <= 15000, 35).when(d > 30000, -100).otherwise(0)
        + F.when(col(id_hit), 120).otherwise(0)
        + F.when(normalize_name(name) == t, 100).otherwise(0)
        + F.when(normalize_name(city) == t, 80).otherwise(0)
        + F.when((t != "") & F.startswith(normalize_name(formatted), t), 60).otherwise(0)
        + F.when(settlement, 50).when(cls != "", -80).otherwise(0)
        + F.when((cls != "") & F.contains(cats, cls), 20).otherwise(0)
    )


def feature_is_typed(place: ColumnOrName, categories: ColumnOrName) -> Column:
    cats, cls = F.lower(F.trim(F.coalesce(col(categories), F.lit("")))), F.lower(F.trim(F.coalesce(col(place), F.lit(""))))
    return (
        (cats == "") | (cls == "")
        | F.contains(cats, F.concat(F.lit("administrative."), cls)) | F.contains(cats, F.concat(F.lit("place."), cls))
    )


def feature_match_top1(df: DataFrame, entity: str, score: Column, typed: Column, tie: Sequence[str]) -> DataFrame:
    """Best feature per place with at least 50 points. Features of the right type
    alone compete where a place has any, even when they score too low."""
    scored = df.withColumns({"__score": score, "__typed": typed})
    best = first_match(
        scored, [entity], [F.col("__typed").desc(), (F.col("__score") >= 50).desc(), F.col("__score").desc(), *tie]
    )
    return best.filter("__score >= 50").withColumnRenamed("__score", "match_score").drop("__typed")
