"""Distance, bearing and earth-centred coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import ColumnOrName, col, num

WGS84_AXIS = 6378137.0
WGS84_FLATTENING = 1.0 / 298.257223563
MEAN_RADIUS_M = 6371000.0


def _half_chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp = p2 - p1
    dl = F.radians(lng2) - F.radians(lng1)
    sp, sl = F.sin(dp / 2), F.sin(dl / 2)
    return sp * sp + F.cos(p1) * F.cos(p2) * sl * sl


def haversine(
    lat1: ColumnOrName, lng1: ColumnOrName, lat2: ColumnOrName, lng2: ColumnOrName, radius: float
) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    h = _half_chord(col(lat1), col(lng1), col(lat2), col(lng2))
    return F.lit(radius) * 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - h)))


def distance_km(lat1, lng1, lat2, lng2, axis: float = WGS84_AXIS) -> Column:
    return haversine(lat1, lng1, lat2, lng2, axis / 1000.0)


def distance_m(lat1, lng1, lat2, lng2) -> Column:
    return haversine(lat1, lng1, lat2, lng2, MEAN_RADIUS_M)


def projected_distance_m(a: dict[str, ColumnOrName], b: dict[str, ColumnOrName]) -> Column:
    """Planar distance inside one UTM zone, great-circle across zones.

    Both sides map ``x y zone lat lng`` to columns; NULL when neither form applies.
    """
    ax, ay, az = col(a["x"]), col(a["y"]), col(a["zone"])
    bx, by, bz = col(b["x"]), col(b["y"]), col(b["zone"])
    planar = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    return F.when((az > 0) & (az == bz), planar).otherwise(
        distance_m(a["lat"], a["lng"], b["lat"], b["lng"])
    )


def bearing(lat1: ColumnOrName, lng1: ColumnOrName, lat2: ColumnOrName, lng2: ColumnOrName) -> Column:
    """Initial bearing, 0 to 360 degrees."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dl = F.radians(col(lng2) - col(lng1))
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return (F.degrees(F.atan2(east, north)) + 360) % 360


def destination(
    lat: ColumnOrName,
    lng: ColumnOrName,
    bearing_deg: Column | float,
    dist_km: Column | float,
    radius_km: float = 6371.0,
) -> Column:
    """Struct (lat, lng) reached from a point along a bearing."""
    p1, l1 = F.radians(col(lat)), F.radians(col(lng))
    b, d = F.radians(num(bearing_deg)), num(dist_km) / radius_km
    sin_p2 = F.sin(p1) * F.cos(d) + F.cos(p1) * F.sin(d) * F.cos(b)
    p2 = F.asin(sin_p2)
    l2 = l1 + F.atan2(F.sin(b) * F.sin(d) * F.cos(p1), F.cos(d) - F.sin(p1) * F.sin(p2))
    return F.struct(F.degrees(p2).alias("lat"), F.degrees(l2).alias("lng"))


def pixel_distance(x1: ColumnOrName, y1: ColumnOrName, x2: ColumnOrName, y2: ColumnOrName) -> Column:
    dx = (col(x2) - col(x1)).cast("double")
    dy = (col(y2) - col(y1)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def to_ecef(
    lat: ColumnOrName,
    lng: ColumnOrName,
    height: Column | float = 0.0,
    axis: float = WGS84_AXIS,
    minor: float | None = None,
) -> Column:
    """Earth-centred struct (x, y, z) in metres."""
    b = axis * (1.0 - WGS84_FLATTENING) if minor is None else minor
    ratio2 = (b / axis) ** 2
    p, lam, h = F.radians(col(lat)), F.radians(col(lng)), num(height)
    n = F.lit(axis) / F.sqrt(F.lit(1.0) - (1.0 - ratio2) * F.sin(p) * F.sin(p))
    return F.struct(
        ((n + h) * F.cos(p) * F.cos(lam)).alias("x"),
        ((n + h) * F.cos(p) * F.sin(lam)).alias("y"),
        ((n * ratio2 + h) * F.sin(p)).alias("z"),
    )


def from_ecef(
    x: ColumnOrName,
    y: ColumnOrName,
    z: ColumnOrName,
    axis: float = WGS84_AXIS,
    minor: float | None = None,
) -> Column:
    """Geodetic struct (lat, lng); closed form of Bowring."""
    b = axis * (1.0 - WGS84_FLATTENING) if minor is None else minor
    e2 = 1.0 - (b / axis) ** 2
    ep2 = (axis / b) ** 2 - 1.0
    cx, cy, cz = col(x), col(y), col(z)
    p = F.sqrt(cx * cx + cy * cy)
    theta = F.atan2(cz * axis, p * b)
    st, ct = F.sin(theta), F.cos(theta)
    lat = F.atan2(cz + ep2 * b * st * st * st, p - e2 * axis * ct * ct * ct)
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(cy, cx)).alias("lng"))
