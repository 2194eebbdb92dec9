"""Looking back in ordered groups of any size.

A group may be far too large for one task (one GPS session with a third of all
fixes). With ``bucket`` (an expression that never decreases along the order,
such as the day of a timestamp) each window covers one bucket of one group only;
the last row of a bucket is carried into the next one that has rows, so results
are the same as over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    prefix: str = "prev_",
    bucket: Column | None = None,
) -> DataFrame:
    """Adds the values of the row before, NULL on the first row of a group."""
    if bucket is None:
        w = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns})
    rows = df.withColumns({"__bucket": bucket, "__carry": F.lit(False)})
    needed = list(dict.fromkeys([*order, *columns]))
    tails = rows.groupBy(*keys, "__bucket").agg(
        F.max_by(F.struct(*needed), _order_struct(order)).alias("__tail")
    )
    following = F.lead("__bucket").over(W.partitionBy(*keys).orderBy("__bucket"))
    carried = (
        tails.withColumn("__bucket", following)
        .filter(F.col("__bucket").isNotNull())
        .select(*keys, "__bucket", F.lit(True).alias("__carry"), *[F.col(f"__tail.{c}").alias(c) for c in needed])
    )
    w = W.partitionBy(*keys, "__bucket").orderBy(*order)
    both = rows.unionByName(carried, allowMissingColumns=True)
    return (
        both.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns})
        .filter(~F.col("__carry"))
        .drop("__bucket", "__carry")
    )


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds the latest non-NULL ``value`` up to and including each row."""
    if bucket is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    rows = df.withColumns({"__bucket": bucket, "__value": value})
    tails = rows.groupBy(*keys, "__bucket").agg(
        F.max_by("__value", _order_struct(order)).alias("__any"),
        F.max(F.when(F.col("__value").isNotNull(), F.struct(*[F.col(c) for c in order], F.col("__value")))).alias("__last"),
    )
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(*keys, "__bucket", F.last("__last.__value", ignorenulls=True).over(before).alias("__before"))
    w = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumn("__inside", F.last("__value", ignorenulls=True).over(w))
    return (
        inside.join(carried, [*keys, "__bucket"], "left")
        .withColumn(out, F.coalesce("__inside", "__before"))
        .drop("__bucket", "__value", "__inside", "__before")
    )
