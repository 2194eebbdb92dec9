"""Helpers shared by the operators: staged tables, checked broadcasts, by-value tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import work_folder

#: Words as the contracts have them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship_by_value(module: str) -> None:
    """Pickle the functions of a module into their tasks, so that workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: a batch of very long texts must fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what runs inside (a staged table, a count); the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the planner the true
    size of the table, so that it broadcasts only what is small.
    """
    folder = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pinned(df: DataFrame, *made) -> DataFrame:
    """``df`` with columns that are computed once, in a step of their own.

    A generator of one row: the optimizer moves no filter below it and copies no expression
    across it, into lambdas least of all.
    """
    return df.select("*", F.inline(F.array(F.struct(*made))))


def if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if len(df.limit(max_rows + 1).select(F.lit(1)).groupBy().count().where(F.col("count") <= max_rows).head(1)) else df


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)
