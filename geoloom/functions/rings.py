"""Ring geometry as column expressions.

A ring is ``array<struct<x:double,y:double>>`` without the closing vertex; a
polygon adds ``holes``, an array of rings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import ColumnOrName, col, let

RING = "array<struct<x:double,y:double>>"
EPSILON_M = 0.01
SMALL_RING = 6


def square_ring(x: Column, y: Column, half: Column) -> Column:
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*[F.struct((x + half * sx).alias("x"), (y + half * sy).alias("y")) for sx, sy in corners])


def corners(ring: Column, wrap: bool = True) -> Column:
    """Edges as structs (ax, ay, bx, by); the last one closes the ring."""

    def edge(r: Column) -> Column:
        n = F.size(r)
        return F.transform(
            r if wrap else F.slice(r, F.lit(1), F.greatest(n - 1, F.lit(0))),
            lambda p, i: let(
                F.get(r, F.when(i + 1 < n, i + 1).otherwise(F.lit(0))),
                lambda q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")),
            ),
        )

    return let(ring, edge)


def ring_area(ring: ColumnOrName) -> Column:
    """Shoelace area with the origin at the first vertex; 0 below three vertices."""

    def area(r: Column) -> Column:
        o = F.get(r, F.lit(0))
        twice = F.aggregate(
            corners(r),
            F.lit(0.0),
            lambda acc, e: acc
            + (e["ax"] - o["x"]) * (e["by"] - o["y"])
            - (e["bx"] - o["x"]) * (e["ay"] - o["y"]),
        )
        return F.when(F.size(r) < 3, F.lit(0.0)).otherwise(F.abs(twice / 2))

    return let(col(ring), area)


def net_area(outer: ColumnOrName, holes: ColumnOrName) -> Column:
    inner = F.aggregate(col(holes), F.lit(0.0), lambda acc, h: acc + ring_area(h))
    return F.greatest(F.lit(0.0), ring_area(outer) - F.coalesce(inner, F.lit(0.0)))


def bounding(ring: ColumnOrName) -> Column:
    """Struct (min_x, min_y, max_x, max_y)."""
    r = col(ring)
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def compactness(outer: ColumnOrName, holes: ColumnOrName) -> Column:
    b = bounding(outer)
    box = F.abs((b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"]))
    return F.when(box < 0.0001, F.lit(0.0)).otherwise(net_area(outer, holes) / box)


def point_in_ring(px: ColumnOrName, py: ColumnOrName, ring: ColumnOrName, slack: float = 1e-6) -> Column:
    """Ray-cast parity; ``slack`` is added to the denominator of the slope."""
    x, y = col(px), col(py)

    def crossings(r: Column) -> Column:
        # each edge runs from the current vertex to the one before it
        return F.aggregate(
            corners(r),
            F.lit(False),
            lambda acc, e: F.when(
                ((e["by"] > y) != (e["ay"] > y))
                & (x < (e["ax"] - e["bx"]) * (y - e["by"]) / (e["ay"] - e["by"] + slack) + e["bx"]),
                ~acc,
            ).otherwise(acc),
        )

    return F.when(F.size(col(ring)) < 3, F.lit(False)).otherwise(let(col(ring), crossings))


def point_in_polygon(px: ColumnOrName, py: ColumnOrName, outer: ColumnOrName, holes: ColumnOrName, slack: float = 1e-6) -> Column:
    """In the outer ring and in none of its holes."""
    in_hole = F.exists(col(holes), lambda h: point_in_ring(px, py, h, slack))
    return point_in_ring(px, py, outer, slack) & ~F.coalesce(in_hole, F.lit(False))


def flat_ring(ring: Column, prefix: str) -> dict[str, Column]:
    """Coordinates of a small ring as plain columns; places beyond its end repeat the first vertex."""
    n, first = F.size(ring), F.get(ring, F.lit(0))

    def at(i: int, axis: str) -> Column:
        v = F.when(n > i, F.get(ring, F.lit(i))[axis]).otherwise(first[axis])
        return F.coalesce(F.when((n >= 3) & (n <= SMALL_RING), v), F.lit(0.0))

    return {f"{prefix}{axis}{i}": at(i, axis) for i in range(SMALL_RING) for axis in ("x", "y")}


def is_small_ring(ring: Column) -> Column:
    whole = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.coalesce((F.size(ring) <= SMALL_RING) & whole, F.lit(False))


def point_in_flat_ring(px: ColumnOrName, py: ColumnOrName, prefix: str, slack: float = 1e-6) -> Column:
    """:func:`point_in_ring` on the columns of :func:`flat_ring`: no loop, so Spark compiles it."""
    x, y = col(px), col(py)
    crossed = F.lit(0)
    for i in range(SMALL_RING):
        j = (i + 1) % SMALL_RING
        ax, ay, bx, by = (F.col(f"{prefix}{c}") for c in (f"x{i}", f"y{i}", f"x{j}", f"y{j}"))
        crossed = crossed + F.when(((by > y) != (ay > y)) & (x < (ax - bx) * (y - by) / (ay - by + slack) + bx), 1).otherwise(0)
    return crossed % 2 == 1


def segment_distance(
    px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, epsilon: float = EPSILON_M
) -> Column:
    """Distance from a point to a segment, clamped at its ends."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(
        length2 <= epsilon * epsilon, F.lit(0.0)
    ).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / length2, F.lit(0.0)), F.lit(1.0)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def boundary_distance(px: ColumnOrName, py: ColumnOrName, outer: ColumnOrName, holes: ColumnOrName) -> Column:
    """Least distance to any edge of the polygon."""
    x, y = col(px), col(py)

    def ring_min(r: Column) -> Column:
        return F.array_min(
            F.transform(corners(r), lambda e: segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"]))
        )

    inner = F.array_min(F.transform(col(holes), ring_min))
    return F.least(ring_min(col(outer)), inner)


def _cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_intersect(a: Column, b: Column, epsilon: float = EPSILON_M) -> Column:
    """Do two edges (structs ax ay bx by) meet? Touching within ``epsilon`` counts."""
    p, q, r, s = (
        (a["ax"], a["ay"]), (a["bx"], a["by"]), (b["ax"], b["ay"]), (b["bx"], b["by"]),
    )
    c1, c2 = _cross(*p, *q, *r), _cross(*p, *q, *s)
    c3, c4 = _cross(*r, *s, *p), _cross(*r, *s, *q)

    def apart(u: Column, v: Column) -> Column:
        return ((u > epsilon) & (v < -epsilon)) | ((u < -epsilon) & (v > epsilon))

    def on(u, v, w) -> Column:
        return (
            (v[0] >= F.least(u[0], w[0]) - epsilon) & (v[0] <= F.greatest(u[0], w[0]) + epsilon)
            & (v[1] >= F.least(u[1], w[1]) - epsilon) & (v[1] <= F.greatest(u[1], w[1]) + epsilon)
        )

    return (
        (apart(c1, c2) & apart(c3, c4))
        | ((F.abs(c1) <= epsilon) & on(p, r, q))
        | ((F.abs(c2) <= epsilon) & on(p, s, q))
        | ((F.abs(c3) <= epsilon) & on(r, p, s))
        | ((F.abs(c4) <= epsilon) & on(r, q, s))
    )


def drop_repeated(ring: ColumnOrName, tolerance: float = EPSILON_M, planar: bool = True, closing: bool = True) -> Column:
    """Drop a vertex that equals the last kept one, and the closing vertex.

    ``planar`` compares straight distance, otherwise each axis by itself.
    """

    def same(p: Column, q: Column) -> Column:
        dx, dy = p["x"] - q["x"], p["y"] - q["y"]
        if planar:
            return dx * dx + dy * dy <= tolerance * tolerance
        return (F.abs(dx) <= tolerance) & (F.abs(dy) <= tolerance)

    empty = F.array().cast(RING)
    # sequential by nature: each vertex is compared with the last one kept
    kept = F.aggregate(
        col(ring),
        empty,
        lambda acc, p: F.when(
            (F.size(acc) > 0) & F.coalesce(same(F.try_element_at(acc, F.lit(-1)), p), F.lit(False)), acc
        ).otherwise(F.array_append(acc, F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))),
    )
    if not closing:
        return kept
    return let(
        kept,
        lambda k: F.when(
            (F.size(k) > 1) & same(F.get(k, F.lit(0)), F.try_element_at(k, F.lit(-1))),
            F.slice(k, F.lit(1), F.greatest(F.size(k) - 1, F.lit(0))),
        ).otherwise(k),
    )


def parse_ring_text(text: ColumnOrName, strict: bool = False) -> Column:
    """``x,y;x,y`` to a ring. Lenient: bad pairs are skipped. Strict: one bad
    pair makes the whole ring NULL."""
    pairs = F.filter(F.transform(F.split(col(text), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def vertex(p: Column) -> Column:
        xy = F.filter(F.transform(F.split(p, ","), lambda v: F.trim(v)), lambda v: v != "")
        return let(
            xy,
            lambda v: F.when(
                F.size(v) == 2,
                F.struct(F.get(v, F.lit(0)).try_cast("double").alias("x"), F.get(v, F.lit(1)).try_cast("double").alias("y")),
            ),
        )

    def good(v: Column) -> Column:
        return F.coalesce(v["x"].isNotNull() & v["y"].isNotNull(), F.lit(False))

    vertices = F.transform(pairs, vertex)
    if strict:
        return let(vertices, lambda vs: F.when((F.size(vs) > 0) & F.forall(vs, good), vs))
    return F.coalesce(F.filter(vertices, good), F.array().cast(RING))


def ring_text(ring: ColumnOrName) -> Column:
    """Ring to text: up to three decimals, no trailing zeros."""

    def short(v: Column) -> Column:
        t = F.format_string("%.3f", v)
        cut = F.regexp_replace(t, r"\.?0+$", "")
        return F.when(cut.isin("-0", ""), F.lit("0")).otherwise(cut)

    return F.array_join(F.transform(col(ring), lambda p: F.concat(short(p["x"]), F.lit(","), short(p["y"]))), ";")
