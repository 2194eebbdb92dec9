"""Geographic views derived from integer keys of the shared tables.

Only integer arithmetic and one division are used, so every engine derives the
same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.tables import table


def world_lng(k: Column) -> Column:
    return (k.cast("bigint") * 7919 % 3600000) / F.lit(1e4) - 180


def world_lat(k: Column) -> Column:
    return (k.cast("bigint") * 104729 % 1600000) / F.lit(1e4) - 80


def region_lng(k: Column) -> Column:
    return F.lit(5.5) + (k.cast("bigint") * 7919 % 10000) / F.lit(1e4)


def region_lat(k: Column) -> Column:
    return F.lit(49.0) + (k.cast("bigint") * 104729 % 10000) / F.lit(1e4)


def with_world(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"lng": world_lng(F.col(key)), "lat": world_lat(F.col(key))})


def with_region(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"lng": region_lng(F.col(key)), "lat": region_lat(F.col(key))})


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return with_world(ev, "event_id")


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return with_world(o, "o_orderkey")


def customer_points(spark: SparkSession, folder: str) -> DataFrame:
    return with_region(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey")


def route_vertices(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("seq"), "l_partkey"
    )
    return with_region(li, "l_partkey").drop("l_partkey")


# The same views for the SQL side.
SQL_WORLD = (
    "(({k}*7919) % 3600000)/1e4 - 180 AS lng, (({k}*104729) % 1600000)/1e4 - 80 AS lat"
)
SQL_REGION = (
    "5.5e0 + (({k}*7919) % 10000)/1e4 AS lng, 49e0 + (({k}*104729) % 10000)/1e4 AS lat"
)


def sql_points(source: str, key: str, kind: str = "world", extra: str = "") -> str:
    coords = (SQL_WORLD if kind == "world" else SQL_REGION).format(k=key)
    cols = f"{extra}, " if extra else ""
    return f"SELECT {cols}{coords} FROM {source}"
