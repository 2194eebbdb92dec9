"""Routes and tracks: legs, lengths, ends, encoded text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import polyline
from geoloom.functions.geodesy import WGS84_AXIS, bearing, distance_km
from geoloom.operators.ordered import with_last_known, with_previous


def leg_metrics(
    df: DataFrame,
    route: str = "route_id",
    order: Sequence[str] = ("seq",),
    lat: str = "lat",
    lng: str = "lng",
    axis: float = WGS84_AXIS,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds ``leg_km`` and ``leg_bearing`` from the vertex before."""
    p = with_previous(df, [route], list(order), [lat, lng], "__prev_", bucket)
    plat, plng = f"__prev_{lat}", f"__prev_{lng}"
    return p.withColumns(
        {"leg_km": distance_km(plat, plng, lat, lng, axis), "leg_bearing": bearing(plat, plng, lat, lng)}
    ).drop(plat, plng)


def route_length_km(df: DataFrame, route: str = "route_id", order: Sequence[str] = ("seq",), **kw) -> DataFrame:
    legs = leg_metrics(df, route, order, **kw)
    return legs.groupBy(route).agg(F.round(F.coalesce(F.sum("leg_km"), F.lit(0.0)), 4).alias("length_km"))


def route_ends(df: DataFrame, route: str = "route_id", order: Sequence[str] = ("seq",), lat: str = "lat", lng: str = "lng") -> DataFrame:
    point, at = F.struct(F.col(lat), F.col(lng)), F.struct(*[F.col(c) for c in order])
    g = df.groupBy(route).agg(F.min_by(point, at).alias("__f"), F.max_by(point, at).alias("__l"))
    return g.select(
        route,
        F.col(f"__f.{lat}").alias("from_lat"), F.col(f"__f.{lng}").alias("from_lng"),
        F.col(f"__l.{lat}").alias("to_lat"), F.col(f"__l.{lng}").alias("to_lng"),
    )


def decode_polylines(df: DataFrame, text: str = "polyline") -> DataFrame:
    """One row per vertex with ``seq`` from 0; the text column is dropped."""
    v = df.select(*[c for c in df.columns if c != text], F.posexplode(polyline.decode(text)).alias("seq", "__v"))
    return v.withColumns({"lat": F.col("__v.lat"), "lng": F.col("__v.lng")}).drop("__v")


def encode_polylines(
    df: DataFrame,
    route: str = "route_id",
    order: Sequence[str] = ("seq",),
    lat: str = "lat",
    lng: str = "lng",
    bucket: Column | None = None,
) -> DataFrame:
    """Vertices to one compact text per route; only step texts are gathered."""
    s = df.withColumns({"__la": polyline.scaled(lat), "__ln": polyline.scaled(lng)})
    s = with_previous(s, [route], list(order), ["__la", "__ln"], "__p", bucket)
    zero = F.lit(0).cast("bigint")
    s = s.withColumns({f"__z{c}": polyline.zigzag(F.col(f"__{c}") - F.coalesce(f"__p__{c}", zero)) for c in ("la", "ln")})
    piece = F.concat(polyline.encode_step("__zla"), polyline.encode_step("__zln"))
    at = F.struct(*[F.col(c) for c in order])
    g = s.groupBy(route).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), piece.alias("piece")))).alias("__p"))
    return g.select(route, F.array_join(F.transform("__p", lambda x: x["piece"]), "").alias("polyline"))


def event_gap_guard(
    df: DataFrame,
    keys: Sequence[str],
    is_start: Column,
    is_end: Column,
    ts: str = "ts",
    tie: Sequence[str] = (),
    minutes: float = 3.0,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds ``refused``: an end event less than ``minutes`` after the latest start
    of its group. An as-of lookup over one ordered pass."""
    order = [ts, *tie]
    s = with_last_known(df, keys, order, F.when(is_start, F.col(ts)), "__start", bucket)
    open_until = F.col("__start") + F.make_dt_interval(mins=F.lit(0), secs=F.lit(minutes * 60.0))
    return s.withColumn("refused", F.coalesce(is_end & (F.col(ts) < open_until), F.lit(False))).drop("__start")


def _field(name: str):
    return lambda x: x[name]


def directions_totals(
    legs: DataFrame, route: str = "route_id", order: str = "leg", parts: Sequence[str] = ("duration", "distance")
) -> DataFrame:
    """Per response: summed values, joined texts, first start and last end."""
    aggs = []
    for p in parts:
        aggs.append(F.sum(f"{p}_value").alias(f"{p}_value"))
        texts = F.array_sort(
            F.collect_list(F.when(F.col(f"{p}_text").isNotNull(), F.struct(F.col(order), F.col(f"{p}_text"))))
        )
        aggs.append(F.array_join(F.transform(texts, _field(f"{p}_text")), ", ").alias(f"{p}_text"))
    start = F.struct("start_lat", "start_lng", "start_address")
    end = F.struct("end_lat", "end_lng", "end_address")
    g = legs.groupBy(route).agg(
        *aggs, F.min_by(start, F.col(order)).alias("__s"), F.max_by(end, F.col(order)).alias("__e")
    )
    return g.select("*", "__s.*", "__e.*").drop("__s", "__e")


def nearest_two(df: DataFrame, keys: Sequence[str], distance: str, tie: Sequence[str]) -> DataFrame:
    """The nearest row per key with the second distance beside it. Only two rows
    per key and task reach the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.col(distance).asc_nulls_last(), *tie)
    top = df.withColumn("__rn", F.row_number().over(order)).filter("__rn <= 2")
    second = F.lead(distance).over(W.partitionBy(*keys).orderBy("__rn"))
    return top.withColumn(f"second_{distance}", second).filter("__rn = 1").drop("__rn")
