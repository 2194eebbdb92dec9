"""Corpus clean-up: quality rules, near-duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.ledger import keep_good
from geoloom.llm.oddsketch import near_duplicates
from geoloom.llm.packing import pack
from geoloom.llm.pii import redact
from geoloom.llm.store import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows without an id all stay."""
    judged = near_duplicates(docs)
    out = staged(judged.where("not kept").select("doc_id").distinct(), "dropped")
    named = docs.where("doc_id is not null").join(out, "doc_id", "left_anti").select(docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token-budget batches."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", dedup),
    ("pii", privacy),
    ("packing", packing),
]

#: Near-duplicate groups, trained redaction and dynamic programming are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
