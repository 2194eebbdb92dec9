"""Tile-grid reference systems and their constants."""

from __future__ import annotations

import math
from dataclasses import dataclass

# ---- fixed values: limits, origins and per-zoom resolutions of public map grids ----
MERCATOR_LAT = 85.05112878

RESOLUTIONS_DEGREES = (
    0.0118973050291514, 0.0059486525145757, 0.00297432625728785, 0.00118973050291514,
    0.00059486525145757, 0.000356919150874542, 0.000178459575437271, 0.000118973050291514,
    5.9486525145757e-05, 3.56919150874542e-05, 1.90356880466422e-05, 9.51784402332112e-06,
    4.75892201166056e-06,
)
RESOLUTIONS_METRES_LKS = (
    1587.5031750063501, 793.7515875031751, 529.1677250021168, 264.5838625010584,
    132.2919312505292, 52.91677250021167, 26.458386250105836, 13.229193125052918,
    6.614596562526459, 2.6458386250105836, 1.3229193125052918, 0.5291677250021167,
    0.26458386250105836,
)
RESOLUTIONS_METRES_SWEREF = (
    4096.0, 2048.0, 1024.0, 512.0, 256.0, 128.0, 64.0, 32.0, 16.0, 8.0, 4.0, 2.0, 1.0, 0.5,
    0.25, 0.15, 0.1, 0.05, 0.01,
)
SWISS_MATRIX = (
    (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (2, 1), (2, 1),
    (2, 1), (2, 2), (3, 2), (3, 2), (4, 3), (8, 5), (19, 13), (38, 25), (94, 63), (188, 125),
    (375, 250), (750, 500), (938, 625), (1250, 834), (1875, 1250), (3750, 2500), (7500, 5000),
    (18750, 12500),
)
GRS80_MINOR = 6356752.3141403561
WGS84_MINOR = 6356752.3142451793


@dataclass(frozen=True)
class Grid:
    """One tile grid. ``kind`` picks the formula; the rest are its parameters."""

    name: str
    kind: str
    min_lat: float
    max_lat: float
    min_lng: float
    max_lng: float
    tile: int = 256
    axis: float = 6378137.0
    origin_x: float = 0.0
    origin_y: float = 0.0
    resolutions: tuple[float, ...] = ()
    scale: float = 1.0
    meridian: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    matrix: tuple[tuple[int, int], ...] = ()


# Limits, origins and scales, as the publishers of the grids state them: EPSG 3857 and 3395
# (world), EPSG 4326 (plate carree), EPSG 3346 (LKS-94), EPSG 3059 (LKS-92), EPSG 3006 (SWEREF 99 TM),
# EPSG 32633 (UTM 33N) and the tile schemes of the national map services.
_WORLD = dict(min_lat=-MERCATOR_LAT, max_lat=MERCATOR_LAT, min_lng=-180.0, max_lng=180.0)
_LKS = dict(kind="transverse", scale=0.9998, meridian=0.41887902047863912, false_easting=500000.0,
            resolutions=RESOLUTIONS_METRES_LKS)

GRIDS: dict[str, Grid] = {
    g.name: g
    for g in (
        Grid("mercator", "mercator", **_WORLD),
        Grid("ellipsoid_mercator", "ellipsoid", min_lat=-MERCATOR_LAT, max_lat=MERCATOR_LAT,
             min_lng=-177.0, max_lng=177.0, axis=6356752.3142),
        Grid("plate_carree", "plate", tile=512, **_WORLD),
        Grid("plate_carree_256", "plate", tile=256, **_WORLD),
        Grid("plate_carree_table", "plate_table", 18.7071563263201, 29.4052130085331,
             41.522866508209, 66.2882966568906, origin_x=-400.0, origin_y=400.0,
             resolutions=RESOLUTIONS_DEGREES),
        Grid("swiss", "swiss", matrix=SWISS_MATRIX, **_WORLD),
        Grid("lks94", min_lat=53.33, max_lat=56.55, min_lng=20.22, max_lng=27.11,
             origin_x=-5122000.0, origin_y=10000100.0, **_LKS),
        Grid("lks94_relief", min_lat=53.33, max_lat=56.55, min_lng=20.22, max_lng=27.11,
             origin_x=-5122000.0, origin_y=10325013.240285, **_LKS),
        Grid("lks92", "transverse", 55.55, 58.22, 20.22, 28.28, scale=0.9996,
             meridian=0.41887902047863912, false_easting=500000.0, false_northing=-6000000.0,
             origin_x=-5120900.0, origin_y=3998100.0, resolutions=RESOLUTIONS_METRES_LKS[:12]),
        Grid("sweref99", "transverse", 54.96, 69.07, 10.0, 24.5, scale=0.9996,
             meridian=math.radians(15), false_easting=500000.0, origin_x=-1200000.0,
             origin_y=8500000.0, resolutions=RESOLUTIONS_METRES_SWEREF),
        Grid("utm33", "utm33", 26.0, 76.0, -26.0, 38.0, scale=0.9996),
    )
}
# ---- end of fixed values ----


def grid(name: str) -> Grid:
    return GRIDS[name]
