"""SQL text pieces shared by the counterpart queries."""

from __future__ import annotations

import math

from geoloom.functions.grids import GRS80_MINOR, MERCATOR_LAT, WGS84_MINOR
from geoloom.operators.transverse import AXIS, arc_coefficients

PI = repr(math.pi)


def n(v: float) -> str:
    """A double literal."""
    t = repr(float(v))
    return f"({t})" if "e" in t else f"({t}e0)"


def merc(lat: str, lng: str, zoom: int | str, tile: int = 256) -> tuple[str, str]:
    w = f"{n(float(tile << zoom))}" if isinstance(zoom, int) else f"({n(tile)} * pow(2e0, {zoom}))"
    sla = f"sin(least(greatest({lat}, {n(-MERCATOR_LAT)}), {n(MERCATOR_LAT)}) * {PI} / 180)"
    lo = f"least(greatest({lng}, -180e0), 180e0)"
    fx = f"(({lo} + 180) / 360 * {w} + 0.5e0)"
    fy = f"((0.5e0 - ln((1 + {sla}) / (1 - {sla})) / (4 * {PI})) * {w} + 0.5e0)"
    return tuple(f"CAST(floor(least(greatest({f}, 0e0), {w} - 1)) AS BIGINT)" for f in (fx, fy))


def merc_tile(lat: str, lng: str, zoom: int | str) -> tuple[str, str]:
    x, y = merc(lat, lng, zoom)
    return f"({x} // 256)", f"({y} // 256)"


def merc_lng(px: str, zoom: int | str) -> str:
    w = f"{n(float(256 << zoom))}" if isinstance(zoom, int) else f"(256e0 * pow(2e0, {zoom}))"
    return f"((least(greatest(CAST({px} AS DOUBLE), 0e0), {w} - 1) / {w} - 0.5e0) * 360)"


def merc_lat(py: str, zoom: int | str) -> str:
    w = f"{n(float(256 << zoom))}" if isinstance(zoom, int) else f"(256e0 * pow(2e0, {zoom}))"
    f = f"(0.5e0 - least(greatest(CAST({py} AS DOUBLE), 0e0), {w} - 1) / {w})"
    return f"(90 - atan(exp(-{f} * 2 * {PI})) * 360 / {PI})"


def hav(lat1: str, lng1: str, lat2: str, lng2: str, radius: float) -> str:
    h = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin((radians({lng2}) - radians({lng1})) / 2), 2))"
    )
    return f"({n(radius)} * 2 * atan2(sqrt({h}), sqrt(greatest(0e0, 1 - {h}))))"


def datum_ctes(src: str, out: str, lat: str = "lat", lng: str = "lng",
               minor_from: float = WGS84_MINOR, minor_to: float = GRS80_MINOR) -> str:
    """CTE adding sla (shifted latitude) by Molodensky's differential formula with equal axes
    and no translation; the longitude is unchanged."""
    es = n(1 - (minor_from / AXIS) ** 2)
    flatter, ratio = n((minor_from - minor_to) / AXIS), n(AXIS / minor_from)
    q = f"(1 - {es} * pow(sin(radians({lat})), 2))"
    # N / M, the ratio of the radii across and along the meridian
    radii = f"({q} / (1 - {es}))"
    return f"""
{out} AS (SELECT *, {lat} + degrees({flatter} * ({ratio} + {radii} / {ratio}) * sin(radians({lat})) * cos(radians({lat}))) AS sla FROM {src})"""


def tm_ctes(src: str, out: str, phi: str, dlam: str, es: float, k0: float, fe: str, fn: str,
            ex: str = "gx", ny: str = "gy") -> str:
    """CTEs adding easting and northing to a relation."""
    ep = es / (1 - es)
    m0, m2, m4, m6 = arc_coefficients(es)
    return f"""
{out}_a AS (SELECT *, {phi} AS p_, {dlam} AS l_ FROM {src}),
{out}_b AS (SELECT *, pow(tan(p_), 2) AS t_, {n(ep)} * pow(cos(p_), 2) AS c_, cos(p_) * l_ AS a_,
   {n(AXIS)} / sqrt(1 - {n(es)} * pow(sin(p_), 2)) AS n_,
   {n(AXIS)} * ({n(m0)} * p_ - {n(m2)} * sin(2 * p_) + {n(m4)} * sin(4 * p_) - {n(m6)} * sin(6 * p_)) AS m_ FROM {out}_a),
{out} AS (SELECT * EXCLUDE (p_, l_, t_, c_, a_, n_, m_),
   {n(k0)} * n_ * (a_ + (1 - t_ + c_) * pow(a_, 3) / 6
     + (5 - 18 * t_ + t_ * t_ + 72 * c_ - {n(58 * ep)}) * pow(a_, 5) / 120) + {fe} AS {ex},
   {n(k0)} * (m_ + n_ * tan(p_) * (a_ * a_ / 2 + (5 - t_ + 9 * c_ + 4 * c_ * c_) * pow(a_, 4) / 24
     + (61 - 58 * t_ + t_ * t_ + 600 * c_ - {n(330 * ep)}) * pow(a_, 6) / 720)) + {fn} AS {ny} FROM {out}_b)"""


WGS84_ES = (1 / 298.257223563) * (2 - 1 / 298.257223563)


def utm_ctes(src: str, out: str, zone: str | None = None) -> str:
    """CTEs adding zone, easting ex and northing ny from lat, lng (zone may be forced)."""
    z = zone or "CAST(least(greatest(floor((lng + 180) / 6) + 1, 1), 60) AS INTEGER)"
    return (
        f"{out}_z AS (SELECT *, {z} AS zone FROM {src}),"
        + tm_ctes(
            f"{out}_z", out, "radians(lat)", "(radians(lng) - radians((zone - 1) * 6e0 - 177))",
            WGS84_ES, 0.9996, "500000e0", "CASE WHEN lat < 0 THEN 10000000e0 ELSE 0e0 END", "ex", "ny",
        )
    )
