"""Equi-joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 5000
ROWS_PER_TASK = 500_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more rows than one task should take, and their number of parts.

    A key is hot only above ``total / MAX_HOT_KEYS`` rows, so there are never
    more than MAX_HOT_KEYS of them, whatever the size of the table: safe to
    broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total")).withColumn("__one", F.lit(1))
    limit = F.greatest(F.lit(rows_per_task).cast("double"), F.col("__total") / MAX_HOT_KEYS)
    hot = counts.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").filter(F.col("__n") > limit)
    return hot.select(*keys, F.ceil(F.col("__n") / rows_per_task).cast("int").alias("__parts"))


def skew_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``left`` joined to ``right`` (inner or left): rows of hot left keys are
    spread over several tasks and the matching right rows are repeated there.

    The part of a row is a hash of its own values, so a retried task puts every
    row where it was before.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(left, keys, rows_per_task))
    spread = left.join(hot, keys, "left").withColumn(
        "__part",
        F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*left.columns), F.col("__parts").cast("bigint")).cast("int")
        ),
    )
    repeated = right.join(hot, keys, "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))
    )
    return spread.drop("__parts").join(repeated.drop("__parts"), [*keys, "__part"], how).drop("__part")
