"""Rectangle arithmetic and predicates.

A rectangle is four columns: top, left, bottom, right (top >= bottom). Given as
a prefix, ``r`` stands for ``r_top r_left r_bottom r_right``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import ColumnOrName, clip, col, num


class Rect(NamedTuple):
    top: Column
    left: Column
    bottom: Column
    right: Column

    def columns(self, prefix: str) -> dict[str, Column]:
        return dict(zip((f"{prefix}_top", f"{prefix}_left", f"{prefix}_bottom", f"{prefix}_right"), self))


def rect(prefix: str) -> Rect:
    return Rect(*[F.col(f"{prefix}_{side}") for side in ("top", "left", "bottom", "right")])


def rect_of(top, left, bottom, right) -> Rect:
    return Rect(num(top), num(left), num(bottom), num(right))


def in_bounds(lat: ColumnOrName, lng: ColumnOrName, r: Rect, mode: str = "half_open") -> Column:
    """``half_open``: left and top edges belong to the rectangle. ``closed``: all
    edges do, and swapped corners are put in order first."""
    la, ln = col(lat), col(lng)
    if mode == "half_open":
        return (ln >= r.left) & (ln < r.right) & (la <= r.top) & (la > r.bottom)
    if mode == "closed":
        n = normalize_bounds(r.top, r.left, r.bottom, r.right)
        return la.between(n.bottom, n.top) & ln.between(n.left, n.right)
    raise ValueError(mode)


def rect_contains(outer: Rect, inner: Rect) -> Column:
    return (
        (outer.left <= inner.left)
        & (inner.right <= outer.right)
        & (outer.top >= inner.top)
        & (inner.bottom >= outer.bottom)
    )


def rect_intersects(a: Rect, b: Rect) -> Column:
    return (a.left < b.right) & (a.top > b.bottom) & (a.right > b.left) & (a.bottom < b.top)


def rect_intersection(a: Rect, b: Rect) -> Rect:
    """Overlap, NULL sides when the rectangles do not meet."""
    top, bottom = F.least(a.top, b.top), F.greatest(a.bottom, b.bottom)
    left, right = F.greatest(a.left, b.left), F.least(a.right, b.right)
    ok = (right >= left) & (top >= bottom)
    return Rect(*[F.when(ok, v) for v in (top, left, bottom, right)])


def rect_union(a: Rect, b: Rect) -> Rect:
    return Rect(
        F.greatest(a.top, b.top),
        F.least(a.left, b.left),
        F.least(a.bottom, b.bottom),
        F.greatest(a.right, b.right),
    )


def rect_inflate(r: Rect, lat, lng) -> Rect:
    dlat, dlng = num(lat), num(lng)
    return Rect(r.top + dlat, r.left - dlng, r.bottom - dlat, r.right + dlng)


def rect_offset(r: Rect, lat, lng) -> Rect:
    """Move right by ``lng`` and down by ``lat``."""
    dlat, dlng = num(lat), num(lng)
    return Rect(r.top - dlat, r.left + dlng, r.bottom - dlat, r.right + dlng)


def rect_center(r: Rect) -> tuple[Column, Column]:
    """(lat, lng) of the middle."""
    return r.top - (r.top - r.bottom) / 2, r.left + (r.right - r.left) / 2


def rect_size(r: Rect) -> tuple[Column, Column]:
    """(height in degrees latitude, width in degrees longitude)."""
    return r.top - r.bottom, r.right - r.left


def normalize_bounds(lat1, lng1, lat2, lng2) -> Rect:
    a, b, c, d = num(lat1), num(lng1), num(lat2), num(lng2)
    return Rect(F.greatest(a, c), F.least(b, d), F.least(a, c), F.greatest(b, d))


KM_PER_DEGREE = 111.32


def pad_bounds_km(r: Rect, km) -> Rect:
    n = normalize_bounds(r.top, r.left, r.bottom, r.right)
    c = F.cos(F.radians((n.top + n.bottom) / 2))
    floored = F.when(F.abs(c) < 0.1, F.lit(0.1)).otherwise(F.abs(c))
    dlat = num(km) / KM_PER_DEGREE
    dlng = num(km) / (F.lit(KM_PER_DEGREE) * floored)
    return Rect(n.top + dlat, n.left - dlng, n.bottom - dlat, n.right + dlng)


def snap_padding(v: ColumnOrName, low=1.0, high=20.0, step=0.5, default=1.0) -> Column:
    c = col(v).cast("double")
    bad = c.isNull() | F.isnan(c) | (c < low) | (c > high)
    return F.when(bad, F.lit(default)).otherwise(F.round(c / step) * step)


def clamp_to_bounds(lat: ColumnOrName, lng: ColumnOrName, r: Rect) -> tuple[Column, Column]:
    """Move outside points just inside: 0.1 % of the size, 1e-5 degrees at least."""
    la, ln = col(lat), col(lng)
    inside = in_bounds(la, ln, r)
    eps_lat = F.greatest(F.lit(1e-5), (r.top - r.bottom) * 0.001)
    eps_lng = F.greatest(F.lit(1e-5), (r.right - r.left) * 0.001)
    cla, cln = clip(la, r.bottom, r.top), clip(ln, r.left, r.right)
    tla = F.when(cla == r.top, r.top - eps_lat).when(cla == r.bottom, r.bottom + eps_lat).otherwise(cla)
    tln = F.when(cln == r.left, r.left + eps_lng).when(cln == r.right, r.right - eps_lng).otherwise(cln)
    return (
        F.when(inside, la).otherwise(clip(tla, r.bottom, r.top)),
        F.when(inside, ln).otherwise(clip(tln, r.left, r.right)),
    )


def same_point(lat1, lng1, lat2, lng2, tol: float = 1e-6) -> Column:
    return (F.abs(col(lat1) - col(lat2)) < tol) & (F.abs(col(lng1) - col(lng2)) < tol)


class PixelRect(NamedTuple):
    """Integer rectangle: x, y and size; right and bottom edges are outside."""

    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h


def pixel_contains(r: PixelRect, x: ColumnOrName, y: ColumnOrName) -> Column:
    cx, cy = col(x), col(y)
    return (cx >= r.x) & (cx < r.right) & (cy >= r.y) & (cy < r.bottom)


def pixel_intersects(a: PixelRect, b: PixelRect) -> Column:
    return (b.x < a.right) & (a.x < b.right) & (b.y < a.bottom) & (a.y < b.bottom)


def pixel_intersection(a: PixelRect, b: PixelRect) -> PixelRect:
    x, y = F.greatest(a.x, b.x), F.greatest(a.y, b.y)
    r, d = F.least(a.right, b.right), F.least(a.bottom, b.bottom)
    ok = (r >= x) & (d >= y)
    return PixelRect(*[F.when(ok, v) for v in (x, y, r - x, d - y)])


def pixel_union(a: PixelRect, b: PixelRect) -> PixelRect:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return PixelRect(x, y, F.greatest(a.right, b.right) - x, F.greatest(a.bottom, b.bottom) - y)


def pixel_inflate(r: PixelRect, dx, dy) -> PixelRect:
    x, y = num(dx), num(dy)
    return PixelRect(r.x - x, r.y - y, r.w + x * 2, r.h + y * 2)
