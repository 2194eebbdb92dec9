"""Grouped summaries of point and tile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extent(df: DataFrame, *by: str, visible: Column | None = None, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Bounding rectangle of the visible points, per layer when ``by`` is given.
    Without grouping an empty input gives one row of NULLs."""
    if visible is not None:
        df = df.filter(visible)
    aggs = (
        F.max(lat).alias("top"), F.min(lng).alias("left"), F.min(lat).alias("bottom"), F.max(lng).alias("right"),
    )
    return df.groupBy(*by).agg(*aggs)


def distinct_values(df: DataFrame, text: str, order: str) -> DataFrame:
    """Distinct texts without regard to case; the first spelling stays."""
    t = F.trim(F.col(text))
    return (
        df.filter(t != "")
        .groupBy(F.lower(t).alias("value_key"))
        .agg(F.min_by(t, F.col(order)).alias("value"))
    )


def find_duplicates(df: DataFrame, text: str) -> DataFrame:
    """Texts that occur more than once without regard to case. Digests are counted;
    only texts whose digest repeats are shuffled, one per task."""
    keyed = df.select(F.lower(F.trim(F.col(text))).alias("value_key")).filter("value_key <> ''")
    keyed = keyed.withColumn("__h", F.sha2(F.col("value_key").cast("binary"), 256))
    counts = keyed.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    texts = keyed.join(counts.select("__h"), "__h", "left_semi").groupBy("__h").agg(F.first("value_key").alias("value_key"))
    return texts.join(counts, "__h").select("value_key", "n")


def split_list(text: Column | str) -> Column:
    """Parts between commas or line breaks: trimmed, distinct without regard to
    case (first spelling stays), sorted."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.transform(F.split(c, r"[\r\n,]+"), lambda v: F.trim(v)), lambda v: v != "")
    first = F.filter(
        F.transform(parts, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))),
        lambda s: F.array_position(F.transform(parts, lambda u: F.lower(u)), s["k"]) == s["i"] + 1,
    )
    return F.transform(F.array_sort(first), lambda s: s["v"])


def hit_source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("hits"))


def provider_outcomes(df: DataFrame, provider: str = "provider", outcome: str = "outcome") -> DataFrame:
    """Per provider: attempts, hits with polygon or center, any transient
    failure, whether all answers were 'not found'."""
    o = F.col(outcome)
    return df.groupBy(provider).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("has_polygon")).alias("with_polygon"),
        F.count_if(F.col("has_center")).alias("with_center"),
        F.bool_or(o == "transient").alias("any_transient"),
        F.bool_and(o == "not_found").alias("all_not_found"),
    )
