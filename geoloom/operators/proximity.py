"""Pairs within a distance, and connected groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geodesy import projected_distance_m
from geoloom.operators.skew import skew_join
from geoloom.operators.spatial import with_nearby_zones
from geoloom.session import cut_lineage

POINT = ("x", "y", "utm_zone", "lat", "lng")


def point_side(prefix: str) -> dict[str, str]:
    return dict(x=f"{prefix}x", y=f"{prefix}y", zone=f"{prefix}utm_zone", lat=f"{prefix}lat", lng=f"{prefix}lng")


def point_columns(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in POINT])


def near_pairs(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str] = ()) -> DataFrame:
    """Rows of ``left`` (point columns ``l_x l_y l_utm_zone l_lat l_lng``) with the
    rows of ``right`` (``r_``...) within ``radius`` metres; adds ``distance_m``.

    The cells are those of the right row's zone. A left point near a zone edge is
    also looked up in the neighbour zone; one degree of longitude is at least
    11.6 km up to 84 degrees of latitude, which bounds how near.
    """
    cell = radius * 1.02 + 10.0
    margin = min(3.0, radius / 11000.0 + 0.01)
    tried = with_nearby_zones(left.filter(F.col("l_lat").isNotNull()), "l_lat", "l_lng", margin, "__tx", "__ty", "__near_zone", "__band")
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    tried = tried.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    tried = tried.withColumns(
        {"__cx": F.floor(F.col("__tx") / cell) + F.col("__dx"), "__cy": F.floor(F.col("__ty") / cell) + F.col("__dy")}
    ).drop("__tx", "__ty", "__band", "__dx", "__dy")
    held = right.filter(F.col("r_x").isNotNull()).withColumns(
        {"__near_zone": F.col("r_utm_zone"), "__cx": F.floor(F.col("r_x") / cell), "__cy": F.floor(F.col("r_y") / cell)}
    )
    met = skew_join(tried, held, [*on, "__near_zone", "__cx", "__cy"])
    d = projected_distance_m(point_side("l_"), point_side("r_"))
    return met.withColumn("distance_m", d).filter(F.col("distance_m") <= radius).drop("__near_zone", "__cx", "__cy")


def connected_groups(nodes: DataFrame, edges: DataFrame, node: str = "id", label: str = "group_id") -> DataFrame:
    """Smallest reachable id of every node. ``edges`` has columns a and b.

    Each round takes the least label over the neighbours and then the label of
    that label, so long chains halve; it stops when no label changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select(F.col(node).alias("n"), F.col(node).alias("l")).distinct())
    while True:
        seen = both.join(labels.withColumnRenamed("n", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        stepped = labels.join(seen.withColumnRenamed("a", "n"), "n", "left").select("n", "l", F.least("l", "m").alias("k"))
        jump = stepped.select(F.col("n").alias("k"), F.col("k").alias("kk"))
        nxt = stepped.join(jump, "k", "left").select("n", F.col("l").alias("old"), F.least("k", "kk").alias("l"))
        nxt = cut_lineage(nxt)
        changed = not nxt.filter("old <> l").isEmpty()
        labels = nxt.select("n", "l")
        if not changed:
            break
    return labels.select(F.col("n").alias(node), F.col("l").alias(label))


def star_edges(df: DataFrame, node: str, keys: Sequence[str]) -> DataFrame:
    """Each row of a key group tied to the least node of the group: as many edges as
    rows, never all pairs."""
    least = df.groupBy(*keys).agg(F.min(node).alias("b"))
    j = skew_join(df.select(*keys, F.col(node).alias("a")), least, list(keys))
    return j.filter("a <> b").select("a", "b")
