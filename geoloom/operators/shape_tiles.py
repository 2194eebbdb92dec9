"""Points and shapes that meet tile by tile inside tasks, without a row for each pair.

A shape is one or several polygons (nested lists of vertices: polygon, ring, vertex; the first
ring is the outer one). It takes the finest level whose tiles are as wide as its box, so
it touches four tiles at most; a point is looked up on each level in use. Tiles are dealt over
groups of bounded size, crowded ones in parts, and a group handles all its tiles at once on arrays.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import rings as G
from geoloom.operators.skew import hot_keys
from geoloom.operators.spatial import MAX_LEVEL, level_size, with_point_cells
from geoloom.session import cut_lineage

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 2000.0
FACTOR = 4.0
TILE = ["utm_zone", "__level", "__cx", "__cy"]
PLACE = [*TILE, "__points_part", "__shapes_part"]
POINTS_AT_ONCE, SHAPES_AT_ONCE = 400_000, 100_000  # of one tile in one task
ROWS_IN_GROUP, MOST_TASKS = 150_000, 4000
WORK_AT_ONCE = 1_000_000  # array elements
MOST_ROWS = 512  # of cells in a tile
MARGIN_M = 0.01  # cells nearer to an edge are not taken as whole
LEAST_RISE_M = 1e-3  # of an edge that is not level, for the slack in the slope to stay within the margin


def rings_of(outer: str = "outer", holes: str = "holes") -> Column:
    """The rings of a polygon, the outer one first."""
    return F.concat(F.array(F.col(outer)), F.coalesce(F.col(holes), F.array().cast(f"array<{G.RING}>")))


def is_regular(rings: Column) -> Column:
    """Whole rings of three vertices at least, whose edges are level or rise by a millimetre."""

    def edge(e: Column) -> Column:
        rise = F.abs(e["by"] - e["ay"])
        return (F.abs(e["ax"]) < 1e9) & (F.abs(e["ay"]) < 1e9) & ((rise == 0) | (rise >= LEAST_RISE_M))

    return F.coalesce(F.forall(rings, lambda r: F.coalesce((F.size(r) >= 3) & F.forall(G.corners(r), edge), F.lit(False))), F.lit(False))


def with_box(shapes: DataFrame) -> DataFrame:
    """Adds the level of a shape's tiles and the box of its ``polygons``; to be kept, as :func:`in_tiles` reads it often."""
    xs, ys = (F.flatten(F.flatten(F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: v[a]))))) for a in "xy")
    s = shapes.withColumns({"__x0": F.array_min(xs), "__y0": F.array_min(ys), "__x1": F.array_max(xs), "__y1": F.array_max(ys)})
    span = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(1e-9))
    return s.withColumn("__level", F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), F.ceil(F.log(span / BASE) / F.log(F.lit(FACTOR))).cast("int"))))


def in_tiles(points: DataFrame, shapes: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What ``work`` gives for the arrays of points and shapes that meet: ``schema``.

    ``points``: utm_zone, x, y and ``point_ref``; ``shapes``: utm_zone, ``shape_ref``, ``polygons`` and what :func:`with_box`
    adds. Both are read several times. References are whole numbers; a shape comes up in several groups, and so does a point.
    """
    s, size = shapes, level_size(F.col("__level"), BASE)
    for cell, a in (("__cx", "x"), ("__cy", "y")):
        s = s.withColumn(cell, F.explode(F.sequence(F.floor(F.col(f"__{a}0") / size), F.floor(F.col(f"__{a}1") / size))))
    s = s.select(*TILE, "shape_ref", "polygons")
    levels = shapes.groupBy("__level").count().collect()
    used = points.sparkSession.createDataFrame([(r[0],) for r in levels], "__level int")
    p = with_point_cells(points.select("utm_zone", "point_ref", "x", "y"), used, "x", "y", BASE)
    crowds = {"__points_part": cut_lineage(hot_keys(p, TILE, POINTS_AT_ONCE)), "__shapes_part": cut_lineage(hot_keys(s, TILE, SHAPES_AT_ONCE))}
    groups = max(1, -(-(points.count() * len(levels) + 2 * sum(r[1] for r in levels)) // ROWS_IN_GROUP))

    def dealt(df: DataFrame, own: str, ref: str) -> DataFrame:
        for name, hot in crowds.items():
            df = df.join(F.broadcast(hot.withColumnRenamed("__parts", name)), TILE, "left").withColumn(name, F.coalesce(name, F.lit(1)))
            here = F.pmod(F.xxhash64(ref), F.col(name).cast("bigint")).cast("int")
            df = df.withColumn(name, here if name == own else F.explode(F.sequence(F.lit(0), F.col(name) - 1)))
        # few bytes with much to do: as many tasks as groups, however small
        return df.withColumn("__group", F.pmod(F.xxhash64(*PLACE), F.lit(groups))).repartition(min(groups, MOST_TASKS), "__group")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(*arrays(a, b)) if len(a) and len(b) else work(None, None)

    left, right = dealt(p, "__points_part", "point_ref"), dealt(s, "__shapes_part", "shape_ref")
    return left.groupBy("__group").cogroup(right.groupBy("__group")).applyInArrow(run, schema)


class Points:
    """Points sorted by tile, row and column of cells, about one a cell."""

    def __init__(self, ref, x, y, key):
        order = np.argsort(key, kind="stable")
        self.ref, self.x, self.y, self.key = ref[order], x[order], y[order], key[order]

    def between(self, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of the points in the columns of a row."""
        first = np.searchsorted(self.key, row * 1024 + c0)
        return first, np.searchsorted(self.key, row * 1024 + c1 + 1) - first

    def keep(self, mask: np.ndarray) -> None:
        self.ref, self.x, self.y, self.key = self.ref[mask], self.x[mask], self.y[mask], self.key[mask]


class Shapes:
    """Shapes as flat arrays of edges; ``tile`` and the tile's cells of each."""

    def __init__(self, ref, polygons: pa.Array, tile, x0, y0, cell, rows, first_row):
        n_polygons = np.asarray(polygons.value_lengths())
        of = polygons.flatten()
        n_rings = np.asarray(of.value_lengths())
        rings = of.flatten()
        n = np.asarray(rings.value_lengths()).astype(np.int64)
        v = rings.flatten()
        self.ax, self.ay = (np.asarray(c, float) for c in v.flatten())
        start = np.cumsum(n) - n
        follow = np.arange(len(self.ax)) + 1
        follow[start + n - 1] = start
        self.bx, self.by = self.ax[follow], self.ay[follow]
        self.ring_starts = np.zeros(len(self.ax), bool)
        self.ring_starts[start] = True
        first_ring = np.cumsum(n_rings) - n_rings
        self.polygon_starts = np.zeros(len(self.ax), bool)
        self.polygon_starts[start[first_ring]] = True
        first_polygon = np.cumsum(n_polygons) - n_polygons
        self.edges0 = start[first_ring[first_polygon]]
        self.edges = np.diff(np.r_[self.edges0, len(self.ax)])
        self.ref, self.tile, self.x0, self.y0, self.cell, self.rows, self.first_row = ref, tile, x0, y0, cell, rows, first_row
        low, high = (lambda c: np.minimum.reduceat(c, self.edges0)), (lambda c: np.maximum.reduceat(c, self.edges0))
        m = MARGIN_M / cell
        clip = lambda c, a, top: np.clip(np.floor(c), a, top).astype(np.int64)
        self.r0, self.r1 = clip((low(self.ay) - y0) / cell - m, 0, rows), clip((high(self.ay) - y0) / cell + m, -1, rows - 1)
        self.c0, self.c1 = clip((low(self.ax) - x0) / cell - m, 0, rows), clip((high(self.ax) - x0) / cell + m, -1, rows - 1)

    def inside(self, shape: np.ndarray, x: np.ndarray, y: np.ndarray, slack: float = 1e-6) -> np.ndarray:
        """Is each point in its shape? The test of ``rings.point_in_polygon``, edge by edge."""
        out = np.zeros(len(shape), bool)
        for lo, hi in shares(self.edges[shape]):
            at = shape[lo:hi]
            m = self.edges[at]
            e = spans(self.edges0[at], m)
            px, py = np.repeat(x[lo:hi], m), np.repeat(y[lo:hi], m)
            ay, by, bx = self.ay[e], self.by[e], self.bx[e]
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed = ((by > py) != (ay > py)) & (px < (self.ax[e] - bx) * (py - by) / (ay - by + slack) + bx)
            ring = np.flatnonzero(self.ring_starts[e])
            odd = np.add.reduceat(crossed, ring, dtype=np.int64) & 1
            outer = self.polygon_starts[e[ring]]
            # within the outer ring and in no hole: nothing speaks against it
            polygon = np.flatnonzero(outer)
            good = np.add.reduceat(np.where(outer, 1 - odd, odd), polygon) == 0
            pair = np.searchsorted(ring[polygon], np.cumsum(m) - m)
            out[lo:hi] = np.add.reduceat(good, pair, dtype=np.int64) > 0
        return out


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n numbers for each."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def shares(cost: np.ndarray, most: int = WORK_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` cost, of one element at least."""
    total, lo = np.cumsum(cost), 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def arrays(a: pa.Table, b: pa.Table) -> tuple[Points, Shapes]:
    place = np.concatenate([np.stack([np.asarray(t[c]).astype(np.int64) for c in PLACE], 1) for t in (a, b)])
    tiles, tile = np.unique(place, axis=0, return_inverse=True)
    tile = tile.reshape(-1)
    tp, ts = tile[: len(a)], tile[len(a) :]
    side = BASE * FACTOR ** tiles[:, 1].astype(float)
    x0, y0 = tiles[:, 2] * side, tiles[:, 3] * side
    rows = np.clip(np.ceil(np.sqrt(np.bincount(tp, minlength=len(tiles)))), 1, MOST_ROWS).astype(np.int64)
    cell, first_row = side / rows, np.cumsum(rows) - rows
    x, y = np.asarray(a["x"], float), np.asarray(a["y"], float)
    at = lambda v, o: np.clip(np.floor((v - o[tp]) / cell[tp]), 0, rows[tp] - 1).astype(np.int64)
    points = Points(np.asarray(a["point_ref"]), x, y, (first_row[tp] + at(y, y0)) * 1024 + at(x, x0))
    polygons = b["polygons"].combine_chunks()
    polygons = polygons.chunk(0) if isinstance(polygons, pa.ChunkedArray) else polygons
    return points, Shapes(np.asarray(b["shape_ref"]), polygons, ts, x0[ts], y0[ts], cell[ts], rows[ts], first_row[ts])


def counted(points: Points | None, shapes: Shapes | None) -> pa.Table:
    """shape_ref, n: the number of points in each shape.

    Cells that no edge comes near are in or out as a whole, run by run of each row; points of
    the other cells are tested.
    """
    if points is None:
        return pa.table({"shape_ref": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    found = np.zeros(len(shapes.ref), np.int64)
    tall = np.maximum(shapes.r1 - shapes.r0 + 1, 0) * (shapes.c1 >= shapes.c0)
    for lo, hi in shares((tall + 1) * (shapes.edges + 2)):
        part = np.arange(lo, hi)
        # cells near the edges: for each edge and row, the columns in which it runs
        e, owner = np.arange(shapes.edges0[lo], shapes.edges0[hi - 1] + shapes.edges[hi - 1]), np.repeat(part, shapes.edges[lo:hi])
        cell, rows, m = shapes.cell[owner], shapes.rows[owner], MARGIN_M / shapes.cell[owner]
        ua, ub = (shapes.ax[e] - shapes.x0[owner]) / cell, (shapes.bx[e] - shapes.x0[owner]) / cell
        va, vb = (shapes.ay[e] - shapes.y0[owner]) / cell, (shapes.by[e] - shapes.y0[owner]) / cell
        r0 = np.clip(np.floor(np.minimum(va, vb) - m), 0, rows).astype(np.int64)
        r1 = np.clip(np.floor(np.maximum(va, vb) + m), -1, rows - 1).astype(np.int64)
        n = np.maximum(r1 - r0 + 1, 0)
        k, row = np.repeat(np.arange(len(e)), n), spans(r0, n)
        ua, ub, va, vb, m, rows, owner = ua[k], ub[k], va[k], vb[k], m[k], rows[k], owner[k]
        rise = np.where(va == vb, 1.0, vb - va)
        t0, t1 = np.clip((row - m - va) / rise, 0, 1), np.clip((row + 1 + m - va) / rise, 0, 1)
        p, q = np.where(va == vb, ua, ua + (ub - ua) * t0), np.where(va == vb, ub, ua + (ub - ua) * t1)
        c0, c1 = np.floor(np.minimum(p, q) - m), np.floor(np.maximum(p, q) + m)
        near = (c1 >= 0) & (c0 < rows)
        owner, row = owner[near], row[near]
        c0, c1 = np.maximum(c0[near], 0).astype(np.int64), np.minimum(c1[near], rows[near] - 1).astype(np.int64)
        # an end on both sides of the shape's box in each of its rows
        body = np.repeat(part, tall[lo:hi])
        line = spans(shapes.r0[lo:hi], tall[lo:hi])
        owner, row = np.concatenate([owner, body, body]), np.concatenate([row, line, line])
        c0, c1 = np.concatenate([c0, shapes.c0[body] - 1, shapes.c1[body] + 1]), np.concatenate([c1, shapes.c0[body] - 1, shapes.c1[body] + 1])
        order = np.lexsort((c0, row, owner))
        owner, row, c0, c1 = owner[order], row[order], c0[order], c1[order]
        if not len(owner):
            continue
        fresh = np.r_[True, (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])]
        line = np.cumsum(fresh) * 2048
        reach = np.maximum.accumulate(line + c1) - line
        start = np.r_[True, fresh[1:] | (c0[1:] > reach[:-1])]
        at = np.flatnonzero(start)
        c0, c1, owner, row, fresh = c0[at], reach[np.r_[at[1:] - 1, len(reach) - 1]], owner[at], row[at], fresh[at]
        base = shapes.first_row[owner]
        # runs between them: one test for all
        gap = np.flatnonzero(~fresh[1:] & (c0[1:] > c1[:-1] + 1)) + 1
        g0, g1 = c1[gap - 1] + 1, c0[gap] - 1
        _, many = points.between(base[gap] + row[gap], g0, g1)
        gap, g0, many = gap[many > 0], g0[many > 0], many[many > 0]
        s = owner[gap]
        x, y = shapes.x0[s] + (g0 + 0.5) * shapes.cell[s], shapes.y0[s] + (row[gap] + 0.5) * shapes.cell[s]
        found += np.bincount(s, many * shapes.inside(s, x, y), len(found)).astype(np.int64)
        # points near the edges
        c0, c1 = np.maximum(c0, 0), np.minimum(c1, shapes.rows[owner] - 1)
        first, many = points.between(base + row, c0, c1)
        many = np.where(c1 >= c0, many, 0)
        for a, b in shares(many):
            p, s = spans(first[a:b], many[a:b]), np.repeat(owner[a:b], many[a:b])
            found += np.bincount(s[shapes.inside(s, points.x[p], points.y[p])], minlength=len(found))
    return pa.table({"shape_ref": pa.array(shapes.ref.astype(np.int64)), "n": pa.array(found)})


def least_shape(points: Points | None, shapes: Shapes | None) -> pa.Table:
    """point_ref, shape_ref: the least shape that holds each point.

    Shapes come in their order, some at a time, and a point that is held goes no further.
    """
    refs, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if points is not None:
        order = np.argsort(shapes.ref, kind="stable")
        order = order[(shapes.r1 >= shapes.r0)[order] & (shapes.c1 >= shapes.c0)[order]]
        while len(order) and len(points.ref):
            tall = (shapes.r1 - shapes.r0 + 1)[order]
            _, step = next(shares(tall, max(WORK_AT_ONCE // 4, 1)))
            s, n = order[:step], tall[:step]
            row = shapes.first_row[np.repeat(s, n)] + spans(shapes.r0[s], n)
            owner = np.repeat(s, n)
            first, many = points.between(row, shapes.c0[owner], shapes.c1[owner])
            of = np.add.reduceat(many, np.cumsum(n) - n)
            # about as many pairs as there are points at once
            _, some = next(shares(of, max(len(points.ref), 1000)))
            upto = int(np.cumsum(n)[some - 1])
            owner, first, many = owner[:upto], first[:upto], many[:upto]
            best = np.full(len(points.ref), np.iinfo(np.int64).max)
            for a, b in shares(many):
                p, w = spans(first[a:b], many[a:b]), np.repeat(owner[a:b], many[a:b])
                hit = shapes.inside(w, points.x[p], points.y[p])
                np.minimum.at(best, p[hit], shapes.ref[w[hit]])
            held = best < np.iinfo(np.int64).max
            refs.append(points.ref[held])
            least.append(best[held])
            points.keep(~held)
            order = order[some:]
            if held.any() and len(order):
                # shapes of tiles without points left need not come up
                left = np.unique(points.key // 1024)
                after = np.searchsorted(left, shapes.first_row[order] + shapes.rows[order])
                order = order[after > np.searchsorted(left, shapes.first_row[order])]
    return pa.table({"point_ref": pa.array(np.concatenate(refs).astype(np.int64)), "shape_ref": pa.array(np.concatenate(least).astype(np.int64))})
