"""Rings held as vertex tables: (ring key, seq, coordinates)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.ordered import with_previous


def leg_corners(df: DataFrame, ring: str, seq: str, columns: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Adds ``next_`` columns: the following vertex, the first one at the end.

    The look-ahead is a look-back over the negated order; the first vertex per
    ring is a small aggregate.
    """
    flip = df.withColumn("__back", -F.col(seq))
    nxt = with_previous(flip, [ring], ["__back"], list(columns), "next_", None if bucket is None else -bucket)
    first = df.groupBy(ring).agg(F.min_by(F.struct(*columns), F.col(seq)).alias("__first"))
    out = nxt.join(first, ring)
    for c in columns:
        out = out.withColumn(f"next_{c}", F.coalesce(f"next_{c}", f"__first.{c}"))
    return out.drop("__first", "__back")
