"""Near-duplicate vectors: cover trees traversed in pairs, exact at a cosine threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.components import connected
from geoloom.llm.store import ship_by_value, staged

ship_by_value(__name__)

#: Room for rounding in distances of unit vectors; pairs inside it are decided by their cosine.
EPS = 1e-9


@dataclass
class Tree:
    """Nodes of nested levels: a centre, the true covering radius, children or the points of a leaf."""

    center: np.ndarray
    radius: np.ndarray
    children: list[np.ndarray]
    points: list[np.ndarray]


def cover_tree(x: np.ndarray, leaf: int = 64, fan: int = 16) -> Tree:
    """A tree over the rows of ``x``.

    Each level aims at half the radius of the one above: a node keeps its centre and adds the
    point farthest from all centres until every point is within that radius, or there are
    ``fan`` of them. Radii are measured, so pruning by them is exact in either case.
    """
    center, radius, children, points = [], [], [], []

    def add(at: int, rows: np.ndarray) -> int:
        far = np.sqrt(np.maximum(((x[rows] - x[at]) ** 2).sum(1), 0))
        me = len(center)
        center.append(at)
        radius.append(float(far.max()))
        children.append(np.empty(0, int))
        points.append(rows)
        return me

    todo = [add(0, np.arange(len(x)))] if len(x) else []
    while todo:
        me = todo.pop()
        rows = points[me]
        if len(rows) <= leaf or radius[me] == 0:
            continue
        goal, seeds = radius[me] / 2, [center[me]]
        near = ((x[rows] - x[seeds[0]]) ** 2).sum(1)
        owner = np.zeros(len(rows), int)
        while len(seeds) < fan and near.max() > goal * goal:
            seeds.append(int(rows[near.argmax()]))
            d = ((x[rows] - x[seeds[-1]]) ** 2).sum(1)
            closer = d < near
            near, owner = np.where(closer, d, near), np.where(closer, len(seeds) - 1, owner)
        below = [add(s, rows[owner == k]) for k, s in enumerate(seeds) if (owner == k).any()]
        if len(below) > 1:
            children[me], points[me] = np.array(below), np.empty(0, int)
            todo += below
    return Tree(np.array(center, int), np.array(radius), children, points)


def dual(a: Tree, xa: np.ndarray, b: Tree, xb: np.ndarray, reach: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of point sets that may hold a pair within ``reach``; True where every pair is.

    ``same``: both trees are one, and a set meets itself once. Node pairs farther apart than
    their radii and ``reach`` are pruned; pairs whose radii leave no doubt are given whole.
    """

    def gather(t: Tree, node: int) -> np.ndarray:
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            out.append(t.points[n])
            todo.extend(t.children[n])
        return np.concatenate(out)

    front = np.array([[0, 0]]) if len(a.center) and len(b.center) else np.empty((0, 2), int)
    while len(front):
        i, j = front[:, 0], front[:, 1]
        d = np.sqrt(((xa[a.center[i]] - xb[b.center[j]]) ** 2).sum(1))
        room = a.radius[i] + b.radius[j]
        keep = d <= room + reach + EPS
        sure = keep & (d + room < reach - EPS)
        after = []
        for p, q, whole in zip(i[keep], j[keep], sure[keep], strict=True):
            left, right = a.children[p], b.children[q]
            if whole:
                yield gather(a, p), gather(b, q), True
            elif not len(left) and not len(right):
                yield a.points[p], b.points[q], False
            elif same and p == q:
                after += [(s, t) for k, s in enumerate(left) for t in left[k:]]
            elif len(left) and (not len(right) or a.radius[p] >= b.radius[q]):
                after += [(s, q) for s in left]
            else:
                after += [(p, t) for t in right]
        front = np.array(after, int).reshape(-1, 2)


def meet(xa: np.ndarray, na: np.ndarray, xb: np.ndarray, nb: np.ndarray, cosine: float, same: bool, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links and components of two sets of unit vectors with row counts ``na`` and ``nb``.

    For each vector (those of ``b`` after those of ``a``, only ``a`` if ``same``) the rows of
    other vectors it links with, and the smallest place it is connected to through links here.
    """
    m = len(xa)
    links = np.zeros(m if same else m + len(xb), np.int64)
    label = np.arange(len(links))
    hits = []
    ta = cover_tree(xa, leaf)
    tb = ta if same else cover_tree(xb, leaf)
    shift = 0 if same else m
    for p, q, whole in dual(ta, xa, tb, xb, math.sqrt(2 - 2 * cosine), same):
        ok = np.ones((len(p), len(q)), bool) if whole else xa[p] @ xb[q].T >= cosine
        twice = same and len(p) == len(q) and p[0] == q[0]  # a set that meets itself
        if twice:
            np.fill_diagonal(ok, False)
        if not ok.any():
            continue
        links[p] += ok @ nb[q]
        if not twice:
            links[q + shift] += na[p] @ ok
        hits.append((p, q + shift, None if whole and not twice else ok))
    moved = bool(hits)
    while moved:
        moved = False
        for p, q, ok in hits:
            lp, lq = label[p], label[q]
            if ok is None:
                low = min(lp.min(), lq.min())
                new_p, new_q = np.minimum(lp, low), np.minimum(lq, low)
            else:
                new_p = np.minimum(lp, np.where(ok, lq, len(label)).min(1))
                new_q = np.minimum(lq, np.where(ok, new_p[:, None], len(label)).min(0))
            if (new_p < lp).any() or (new_q < lq).any():
                moved = True
                label[p] = np.minimum(label[p], new_p)
                label[q] = np.minimum(label[q], new_q)
    return links, label


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(vectors.flatten(), float).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", cosine: float = 0.98, cell_rows: int = 4096, max_pivots: int = 4096) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Equal vectors of a group count as one with many rows. A cover tree over a sample of
    pivots, one for each ``cell_rows`` vectors and at most ``max_pivots`` of all groups (this
    bounds what the driver and each task hold of it), deals every vector to its nearest
    pivot. Pairs of cells are pruned by a dual traversal with the cells' measured radii;
    cells far above ``cell_rows`` are cut into parts by hash, and every pair of parts that is left goes to a
    task of its own, which builds cover trees of both and traverses them in pairs. It
    returns counts and a spanning forest, never the pairs themselves.

    Vectors that are null, empty, zero, or hold a null or non-finite component, and vectors
    with a null group or id, link with nothing (a null id: null component, kept); so do vectors of unequal lengths. A
    repeated row counts as another vector. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).alias("grp"), x.alias("x"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    clean = F.transform("x", lambda v: v + F.lit(0.0))
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)) & F.col("grp").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("node", F.when(F.col("ok"), F.concat(F.hex(F.xxhash64("grp", F.size("x"), clean)), F.lit("-"), F.hex(F.xxhash64(clean, F.lit(7), "grp")))))
    rows = staged(rows.select("vec_id", "grp", "node", F.when(F.col("ok"), clean).alias("x")), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("grp").alias("grp"), F.first("x").alias("x"), F.count("*").alias("n"), F.min("vec_id").alias("low"))
    nodes = staged(nodes.withColumn("grp", F.struct("grp", F.size("x").alias("dim"))), "nodes")

    # pivots, and the nearest one of each vector
    want = min(max_pivots, max(1, nodes.count() // cell_rows))
    picked: dict[tuple, list] = {}
    for r in nodes.orderBy("node").limit(want).collect():
        picked.setdefault((r["grp"]["grp"], r["grp"]["dim"]), []).append(r["x"])
    trees = {k: unit(pa.array(v, pa.list_(pa.float64())), k[1]) for k, v in picked.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [(g["grp"], g["dim"]) for g in b.column(1).to_pylist()]
            cell, far = np.zeros(len(keys), np.int64), np.zeros(len(keys))
            for key in set(keys) & set(trees):
                at = np.array([k == key for k in keys])
                u, p = unit(b.column(2).filter(pa.array(at)), key[1]), trees[key]
                d = ((u * u).sum(1)[:, None] + (p * p).sum(1) - 2 * u @ p.T).clip(0)
                cell[at] = d.argmin(1)
                far[at] = np.sqrt(((u - p[cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(far)], names=["node", "cell", "far"])

    dealt = staged(nodes.select("node", "grp", "x").mapInArrow(deal, "node string, cell long, far double"), "dealt")
    dealt = staged(nodes.join(dealt, "node"), "cells")
    cells = staged(dealt.groupBy("grp", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("far")), "sizes")
    parts = F.ceil(F.col("rows") / (2 * cell_rows)).cast("int")

    # cell pairs that the radii leave; groups without a pivot are one cell
    radius = {((r["grp"]["grp"], r["grp"]["dim"]), r["cell"]): r["far"] for r in cells.join(F.broadcast(cells.where("cell > 0").select("grp").distinct().limit(max_pivots)), "grp").limit(max_pivots).collect()}
    reach, near = math.sqrt(2 - 2 * cosine), []
    for key, p in trees.items():
        if not any(k == key for k, _ in radius):
            continue
        far = np.array([radius.get((key, k), -1.0) for k in range(len(p))])
        top = cover_tree(p, leaf=1)
        # a node's radius also covers the vectors of its pivots' cells
        for node in range(len(top.center)):
            top.radius[node] += max(far.max(), 0)
        for s, t, _ in dual(top, p, top, p, reach, True):
            for i in s:
                for j in t:
                    if i != j and far[i] >= 0 and far[j] >= 0 and math.dist(p[i], p[j]) <= far[i] + far[j] + reach + EPS:
                        near.append((key[0], key[1], int(min(i, j)), int(max(i, j))))
    self_pairs = cells.select("grp", F.col("cell").alias("a"), F.col("cell").alias("b"))
    if near:
        kind = nodes.schema["grp"].dataType["grp"].dataType.simpleString()
        pairs = spark.createDataFrame(sorted(set(near), key=repr), f"g {kind}, dim int, a long, b long")
        self_pairs = self_pairs.unionByName(pairs.select(F.struct(F.col("g").alias("grp"), "dim").alias("grp"), "a", "b"))
    side = lambda c: cells.select("grp", F.col("cell").alias(c), F.explode(F.sequence(F.lit(0), parts - 1)).alias(f"k{c}"))
    tasks = self_pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"]).where("a < b or ka <= kb")
    tasks = staged(tasks.select("grp", "a", "ka", "b", "kb"), "tasks")

    placed = dealt.join(cells.select("grp", "cell", parts.alias("parts")), ["grp", "cell"]).withColumn("k", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    whole = placed.select("grp", "cell", "k", "node", "n", "x")
    left = tasks.join(whole.withColumnsRenamed({"cell": "a", "k": "ka"}), ["grp", "a", "ka"]).withColumn("side", F.lit(0))
    right = tasks.where("a <> b or ka <> kb").join(whole.withColumnsRenamed({"cell": "b", "k": "kb"}), ["grp", "b", "kb"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("grp", "a", "ka", "b", "kb", "side", "node", "n", "x")

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sides = np.asarray(t["side"])
        order = np.lexsort((np.asarray(t["node"].to_pylist(), dtype=object).astype(str), sides))
        t, sides = t.take(pa.array(order)).combine_chunks(), sides[order]
        u, n = unit(t["x"].combine_chunks(), len(t["x"][0])), np.asarray(t["n"], np.int64)
        cut = int((sides == 0).sum())
        same = cut == len(sides) and t["a"][0] == t["b"][0] and t["ka"][0] == t["kb"][0]
        links, label = meet(u[:cut], n[:cut], u if same else u[cut:], n if same else n[cut:], cosine, same)
        at = np.flatnonzero(links)
        name = t["node"].combine_chunks()
        return pa.table({"a": name.take(pa.array(at)), "b": name.take(pa.array(label[at])), "links": pa.array(links[at])})

    met = staged(both.groupBy("grp", "a", "ka", "b", "kb").applyInArrow(work, "a string, b string, links long"), "links")
    found = connected(met.select("a", "b")).withColumnRenamed("id", "node")
    counts = met.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    full = nodes.select("node", "n", "low").join(counts, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    full = staged(full, "judged")
    least = full.groupBy("component").agg(F.min("low").alias("component_id"))
    judged = full.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    own = rows.select("vec_id", "node").join(judged, "node", "left")
    return own.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
