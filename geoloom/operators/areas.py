"""Paths and place geometry for display areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import rings as G
from geoloom.functions.rects import Rect, normalize_bounds, rect
from geoloom.operators.skew import skew_join
from geoloom.operators.spatial import MAX_LEVEL, level_size, points_in_areas

DEGREE_EPSILON = 1e-12
RAY_SLACK = 1e-10


def path_intersects_bounds(path: str, r: Rect) -> Column:
    """Does a closed path (x longitude, y latitude) meet the bounds? Boxes first,
    then a vertex inside, a corner inside, and at last crossing edges."""
    n = normalize_bounds(r.top, r.left, r.bottom, r.right)
    box = G.bounding(path)
    apart = (
        (box["max_y"] < n.bottom) | (box["min_y"] > n.top) | (box["max_x"] < n.left) | (box["min_x"] > n.right)
    )
    vertex = F.exists(path, lambda p: p["y"].between(n.bottom, n.top) & p["x"].between(n.left, n.right))
    corners = ((n.top, n.left), (n.top, n.right), (n.bottom, n.right), (n.bottom, n.left))
    corner = None
    for la, ln in corners:
        hit = G.point_in_ring(ln, la, path, RAY_SLACK)
        corner = hit if corner is None else corner | hit
    sides = F.array(
        *[
            F.struct(a[1].alias("ax"), a[0].alias("ay"), b[1].alias("bx"), b[0].alias("by"))
            for a, b in zip(corners, corners[1:] + corners[:1])
        ]
    )
    crossing = F.exists(
        G.corners(F.col(path)), lambda e: F.exists(sides, lambda s: G.segments_intersect(e, s, DEGREE_EPSILON))
    )
    return F.when(F.coalesce(F.size(path), F.lit(0)) == 0, F.lit(False)).when(apart, F.lit(False)).otherwise(
        vertex | corner | crossing
    )


def _with_level(df: DataFrame, box: tuple[str, ...], base: float) -> DataFrame:
    """``__level``: the finest level at which a box is no wider than a cell."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    span = F.greatest(x1 - x0, y1 - y0)
    steps = F.ceil(F.log(F.greatest(span / base, F.lit(1e-9))) / F.log(F.lit(4.0))).cast("int")
    return df.withColumn("__level", F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), steps)))


def _in_cells(df: DataFrame, box: tuple[str, ...], base: float) -> DataFrame:
    """One row per cell a box touches on its ``__level``."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    size = level_size(F.col("__level"), base)
    d = df.withColumn("__cx", F.explode(F.sequence(F.floor(x0 / size), F.floor(x1 / size))))
    return d.withColumn("__cy", F.explode(F.sequence(F.floor(y0 / size), F.floor(y1 / size))))


def box_pairs(left: DataFrame, right: DataFrame, lbox: tuple[str, ...], rbox: tuple[str, ...], base: float) -> DataFrame:
    """Pairs of rows whose closed boxes (min_x, min_y, max_x, max_y columns) meet.

    Two boxes are compared on the coarser of their levels, in the one cell that holds the
    lower left corner of their overlap, so no pair appears twice. The larger box is looked
    up on its own level only, the smaller one there too: small boxes never meet each other
    in the large cells of coarser levels.
    """
    a, b = _with_level(left, lbox, base), _with_level(right, rbox, base)
    upward = F.explode(F.sequence(F.col("__level"), F.lit(MAX_LEVEL)))
    beyond = F.explode(F.filter(F.sequence(F.col("__level"), F.lit(MAX_LEVEL)), lambda k: k > F.col("__level")))
    keys = ["__level", "__cx", "__cy"]
    large_left = skew_join(_in_cells(a, lbox, base), _in_cells(b.withColumn("__level", upward), rbox, base), keys)
    large_right = skew_join(_in_cells(a.withColumn("__level", beyond), lbox, base), _in_cells(b, rbox, base), keys)
    ax0, ay0, ax1, ay1 = (F.col(c) for c in lbox)
    bx0, by0, bx1, by1 = (F.col(c) for c in rbox)
    meet = (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)
    size = level_size(F.col("__level"), base)
    here = (F.floor(F.greatest(ax0, bx0) / size) == F.col("__cx")) & (F.floor(F.greatest(ay0, by0) / size) == F.col("__cy"))
    return large_left.unionByName(large_right).filter(meet & here).drop(*keys)


def paths_in_bounds(paths: DataFrame, areas: DataFrame, path: str = "path", prefix: str = "r", base: float = 0.05) -> DataFrame:
    """Path rows with every area they touch."""
    boxed = paths.withColumns(
        {f"__p{i}": G.bounding(path)[side] for i, side in enumerate(("min_x", "min_y", "max_x", "max_y"))}
    )
    r = rect(prefix)
    n = normalize_bounds(r.top, r.left, r.bottom, r.right)
    held = areas.withColumns({"__a0": n.left, "__a1": n.bottom, "__a2": n.right, "__a3": n.top})
    met = box_pairs(boxed, held, ("__p0", "__p1", "__p2", "__p3"), ("__a0", "__a1", "__a2", "__a3"), base)
    drop = [f"__{k}{i}" for k in "pa" for i in range(4)]
    return met.filter(path_intersects_bounds(path, r)).drop(*drop)


def geometry_for_area(rings: DataFrame, centers: DataFrame, areas: DataFrame, area_id: str, prefix: str = "r") -> DataFrame:
    """What to show of each place in each area.

    ``rings``: place_id, ring_id, path (chosen rings in degrees), linked (accepted by
    link). ``centers``: place_id, lat, lng. Output kind 'ring' for every ring that
    touches the area; 'center' for places without one when it lies inside, and for
    link-accepted places in any case where one of their rings is shown.
    """
    shown = paths_in_bounds(rings, areas, "path", prefix)
    ring_rows = shown.select(area_id, "place_id", "ring_id", F.lit("ring").alias("kind"))
    linked = shown.filter("linked").select(area_id, "place_id").distinct().join(centers.select("place_id"), "place_id")
    inside = points_in_areas(centers, areas, area_id, prefix)
    alone = inside.select(area_id, "place_id").join(ring_rows.select(area_id, "place_id"), [area_id, "place_id"], "left_anti")
    dots = alone.unionByName(linked.select(area_id, "place_id")).distinct()
    return ring_rows.unionByName(dots.select(area_id, "place_id", F.lit(None).cast("bigint").alias("ring_id"), F.lit("center").alias("kind")))


