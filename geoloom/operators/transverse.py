"""Transverse Mercator and datum shift as staged column layers.

Formulas: Snyder, Map Projections - A Working Manual (USGS PP 1395), and the
Redfearn series for the wide UTM-33 grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.core import ColumnOrName, col, staged

AXIS = 6378137.0


def arc_coefficients(es: float) -> tuple[float, float, float, float]:
    """Series of the meridian arc in latitude and its even multiples."""
    e4, e6 = es * es, es * es * es
    return (
        1.0 - es / 4 - 3 * e4 / 64 - 5 * e6 / 256,
        3 * es / 8 + 3 * e4 / 32 + 45 * e6 / 1024,
        15 * e4 / 256 + 45 * e6 / 1024,
        35 * e6 / 3072,
    )


def meridian_arc(phi: Column, axis: float, es: float) -> Column:
    m0, m2, m4, m6 = arc_coefficients(es)
    return F.lit(axis) * (phi * m0 - F.sin(phi * 2) * m2 + F.sin(phi * 4) * m4 - F.sin(phi * 6) * m6)


def forward(
    df: DataFrame,
    phi: ColumnOrName,
    dlon: ColumnOrName,
    easting: str,
    northing: str,
    es: float,
    scale: float,
    false_easting: Column | float,
    false_northing: Column | float,
    axis: float = AXIS,
) -> DataFrame:
    """Radians of latitude and of longitude from the central meridian to metres."""
    ep = es / (1.0 - es)
    fe = false_easting if isinstance(false_easting, Column) else F.lit(false_easting)
    fn = false_northing if isinstance(false_northing, Column) else F.lit(false_northing)
    a, t, c, n = F.col("__a"), F.col("__t"), F.col("__c"), F.col("__n")
    a2 = F.col("__a2")
    east = a * (
        F.lit(1.0)
        + a2 / 6 * (F.lit(1.0) - t + c + a2 / 20 * (F.lit(5.0) - t * 18 + t * t + c * 72 - 58 * ep))
    )
    north = a2 * (
        F.lit(0.5)
        + a2
        / 24
        * (
            F.lit(5.0) - t + c * 9 + c * c * 4
            + a2 / 30 * (F.lit(61.0) - t * 58 + t * t + c * 600 - 330 * ep)
        )
    )
    return staged(
        df,
        {"__phi": col(phi), "__dl": col(dlon)},
        {"__sin": F.sin("__phi"), "__cos": F.cos("__phi"), "__tan": F.tan("__phi")},
        {
            "__n": F.lit(axis) / F.sqrt(F.lit(1.0) - F.col("__sin") * F.col("__sin") * es),
            "__t": F.col("__tan") * F.col("__tan"),
            "__c": F.col("__cos") * F.col("__cos") * ep,
            "__a": F.col("__cos") * F.col("__dl"),
        },
        {"__a2": a * a},
        {
            easting: n * east * scale + fe,
            northing: (meridian_arc(F.col("__phi"), axis, es) + n * F.col("__tan") * north) * scale + fn,
        },
    )


def inverse(
    df: DataFrame,
    x: ColumnOrName,
    y: ColumnOrName,
    phi: str,
    dlon: str,
    es: float,
    scale: float,
    axis: float = AXIS,
) -> DataFrame:
    """Metres from the false origin back to radians (latitude, longitude offset)."""
    ep = es / (1.0 - es)
    m0 = arc_coefficients(es)[0]
    e1 = (1 - math.sqrt(1 - es)) / (1 + math.sqrt(1 - es))
    mu = F.col("__mu")
    foot = (
        mu
        + F.sin(mu * 2) * (3 * e1 / 2 - 27 * e1**3 / 32)
        + F.sin(mu * 4) * (21 * e1**2 / 16 - 55 * e1**4 / 32)
        + F.sin(mu * 6) * (151 * e1**3 / 96)
        + F.sin(mu * 8) * (1097 * e1**4 / 512)
    )
    c, t, n, r, d, d2 = (F.col(f"__{k}") for k in ("c", "t", "n", "r", "d", "d2"))
    lat = F.col("__foot") - n * F.tan("__foot") * d2 / r * (
        F.lit(0.5)
        - d2
        / 24
        * (
            F.lit(5.0) + t * 3 + c * 10 - c * c * 4 - 9 * ep
            - d2 / 30 * (F.lit(61.0) + t * 90 + c * 298 + t * t * 45 - 252 * ep - c * c * 3)
        )
    )
    lon = (
        d
        * (
            F.lit(1.0)
            - d2
            / 6
            * (
                F.lit(1.0) + t * 2 + c
                - d2 / 20 * (F.lit(5.0) - c * 2 + t * 28 - c * c * 3 + 8 * ep + t * t * 24)
            )
        )
        / F.cos("__foot")
    )
    return staged(
        df,
        {"__mu": col(y) / scale / axis / m0, "__x": col(x)},
        {"__foot": foot},
        {
            "__con": F.lit(1.0) - F.sin("__foot") * F.sin("__foot") * es,
            "__c": F.cos("__foot") * F.cos("__foot") * ep,
            "__t": F.tan("__foot") * F.tan("__foot"),
        },
        {"__n": F.lit(axis) / F.sqrt("__con")},
        {"__r": n * (1.0 - es) / F.col("__con"), "__d": F.col("__x") / (n * scale)},
        {"__d2": d * d},
        {phi: lat, dlon: lon},
    )


def to_meridian_plane(
    df: DataFrame, lat: str, minor: float, across: str = "__across", up: str = "__up"
) -> DataFrame:
    """Metres from the axis and above the equator of points on an ellipsoid (height zero)."""
    es = 1.0 - (minor / AXIS) ** 2
    sine = F.sin(F.radians(lat))
    df = df.withColumn("__prime", F.lit(AXIS) / F.sqrt(F.lit(1.0) - sine * sine * es))
    return df.withColumns(
        {across: F.col("__prime") * F.cos(F.radians(lat)), up: F.col("__prime") * sine * (1.0 - es)}
    ).drop("__prime")


def from_meridian_plane(df: DataFrame, across: str, up: str, start: str, minor: float, out: str, turns: int = 3) -> DataFrame:
    """Geodetic degrees by the iteration of Heiskanen and Moritz (Physical Geodesy, 1967):
    tan lat = (up + e2 N(lat) sin lat) / across. Each turn shrinks the error by e2, about
    1/150; ``start`` (degrees) is already within 1e-9 for the ellipsoids in use."""
    es = 1.0 - (minor / AXIS) ** 2
    df = df.withColumn("__turn", F.radians(start))
    for _ in range(turns):
        sine = F.sin("__turn")
        prime = F.lit(AXIS) / F.sqrt(F.lit(1.0) - sine * sine * es)
        df = df.withColumn("__turn", F.atan2(F.col(up) + prime * sine * es, F.col(across)))
    return df.withColumn(out, F.degrees("__turn")).drop("__turn")


def datum_shift(
    df: DataFrame, lat: str, lng: str, out_lat: str, out_lng: str, minor_from: float, minor_to: float
) -> DataFrame:
    """Move degrees from one ellipsoid to another with the same centre and equator: the
    point stays in its meridian plane, so the longitude is unchanged."""
    df = to_meridian_plane(df, lat, minor_from)
    df = from_meridian_plane(df, "__across", "__up", lat, minor_to, out_lat)
    return df.withColumn(out_lng, F.col(lng)).drop("__across", "__up")


def redfearn_forward(
    df: DataFrame, phi: ColumnOrName, dlon: ColumnOrName, easting: str, northing: str, es: float, scale: float
) -> DataFrame:
    """Redfearn series: higher order in longitude, for wide strips."""
    m0, m2, m4, m6 = arc_coefficients(es)
    w, s, c, t2, psi, nu = (F.col(f"__{k}") for k in ("w", "sin", "cos", "t2", "psi", "nu"))
    w2, c2, p2, t4, t6 = w * w, c * c, psi * psi, t2 * t2, t2 * t2 * t2
    p3, p4 = p2 * psi, p2 * p2
    k = w2 * c2
    east = F.lit(1.0) + k / 6 * (psi - t2) + k * k / 120 * (
        p3 * 4 * (F.lit(1.0) - t2 * 6) + p2 * (F.lit(1.0) + t2 * 8) - psi * 2 * t2 + t4
    ) + k * k * k / 5040 * (F.lit(61.0) - t2 * 479 + t4 * 179 - t6)
    head = nu * s * c * w2
    north = head / 2 + head * k / 24 * (p2 * 4 + psi - t2) + head * k * k / 720 * (
        p4 * 8 * (F.lit(11.0) - t2 * 24) - p3 * 28 * (F.lit(1.0) - t2 * 6)
        + p2 * (F.lit(1.0) - t2 * 32) - psi * 2 * t2 + t4
    ) + head * k * k * k / 40320 * (F.lit(1385.0) - t2 * 3111 + t4 * 543 - t6)
    return staged(
        df,
        {"__phi": col(phi), "__w": col(dlon)},
        {"__sin": F.sin("__phi"), "__cos": F.cos("__phi"), "__t2": F.pow(F.tan("__phi"), F.lit(2.0))},
        {"__q": F.lit(1.0) - s * s * es},
        {"__nu": F.lit(AXIS) / F.sqrt("__q"), "__psi": F.col("__q") / (1.0 - es)},
        {
            easting: nu * w * c * east * scale + 500000.0,
            northing: (meridian_arc(F.col("__phi"), AXIS, es) + north) * scale,
        },
    )


def redfearn_inverse(
    df: DataFrame, x: ColumnOrName, y: ColumnOrName, phi: str, dlon: str, es: float, scale: float
) -> DataFrame:
    """Inverse of :func:`redfearn_forward`; ``x`` counts from the central meridian."""
    b = AXIS * math.sqrt(1.0 - es)
    n1 = (AXIS - b) / (AXIS + b)
    g = AXIS * (1 - n1) * (1 - n1**2) * (1 + 9 / 4 * n1**2 + 255 / 64 * n1**4)
    sg = F.col("__sg")
    foot = (
        sg
        + F.sin(sg * 2) * (3 * n1 / 2 - 27 * n1**3 / 32)
        + F.sin(sg * 4) * (21 * n1**2 / 16 - 55 * n1**4 / 32)
        + F.sin(sg * 6) * (151 * n1**3 / 96)
        + F.sin(sg * 8) * (1097 * n1**4 / 512)
    )
    psi, t, t2, xx, e = (F.col(f"__{k}") for k in ("psi", "t", "t2", "xx", "e"))
    t4, t6 = t2 * t2, t2 * t2 * t2
    p2, p3, p4 = psi * psi, psi * psi * psi, psi * psi * psi * psi
    x2 = xx * xx
    lead = t / (F.col("__rho") * scale) * e * xx
    lat = F.col("__foot") - lead / 2 + lead * x2 / 24 * (
        p2 * -4 + psi * 9 * (F.lit(1.0) - t2) + t2 * 12
    ) - lead * x2 * x2 / 720 * (
        p4 * 8 * (F.lit(11.0) - t2 * 24) - p3 * 12 * (F.lit(21.0) - t2 * 71)
        + p2 * 15 * (F.lit(15.0) - t2 * 98 + t4 * 15) + psi * 180 * (t2 * 5 - t4 * 3) + t4 * 360
    ) + lead * x2 * x2 * x2 / 40320 * (F.lit(1385.0) + t2 * 3633 + t4 * 4095 + t6 * 1575)
    lon = (
        xx
        - xx * x2 / 6 * (psi + t2 * 2)
        + xx * x2 * x2 / 120 * (
            p3 * -4 * (F.lit(1.0) - t2 * 6) + p2 * (F.lit(9.0) - t2 * 68) + psi * 72 * t2 + t4 * 24
        )
        - xx * x2 * x2 * x2 / 5040 * (F.lit(61.0) + t2 * 662 + t4 * 1320 + t6 * 720)
    ) / F.cos("__foot")
    return staged(
        df,
        {"__sg": col(y) / scale / g, "__e": col(x)},
        {"__foot": foot},
        {"__q": F.lit(1.0) - F.sin("__foot") * F.sin("__foot") * es, "__t": F.tan("__foot")},
        {"__nu": F.lit(AXIS) / F.sqrt("__q"), "__t2": t * t},
        {"__rho": F.col("__nu") * (1.0 - es) / F.col("__q")},
        {"__psi": F.col("__nu") / F.col("__rho"), "__xx": e / (F.col("__nu") * scale)},
        {phi: lat, dlon: lon},
    )
