"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.store import staged


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of the edges ``(a, b)``; a component is named by its smallest node.

    Each round points every node at its smallest neighbour (a partial aggregate, so a hub
    costs one row per task), follows the pointers once more and contracts the edges. A round
    at least halves the nodes of every unfinished component. All joins read staged tables on
    both sides, so that adaptive execution can split the rows of a hub.
    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    edges = staged(_canonical(edges), "edges")
    maps: list[DataFrame] = []
    while edges.head(1):
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a"))
        near = staged(both.groupBy("id").agg(F.least("id", F.min("to")).alias("label")), "near")
        up = near.select(F.col("id").alias("label"), F.col("label").alias("up"))
        maps.append(staged(near.join(up, "label").select("id", F.col("up").alias("label")), "labels"))
        for end in ("a", "b"):
            to = maps[-1].select(F.col("id").alias(end), F.col("label").alias("to"))
            edges = edges.join(to, end).drop(end).withColumnRenamed("to", end)
        edges = staged(_canonical(edges), "edges")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = maps.pop()
    while maps:
        last = found.select(F.col("id").alias("label"), F.col("label").alias("up"))
        found = maps.pop().join(last, "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    return found.withColumnRenamed("label", "component")
