"""Readers for the shared parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt evenly over tasks, before each of them grows to a document.

    Tasks are cut by the bytes of a file, and a short row that becomes a document of a few kilobytes
    leaves one task with very much to do.
    """
    tasks = -(-df.count() // rows_per_task)
    return df.repartition(tasks) if tasks > 1 else df
