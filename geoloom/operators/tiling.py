"""Points, tiles and tile lists on the supported grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.core import clip, col, num, staged
from geoloom.functions.geodesy import WGS84_FLATTENING
from geoloom.functions.grids import GRS80_MINOR, WGS84_MINOR, Grid, grid
from geoloom.operators import transverse

Zoom = int | str | Column

WGS84_ES = WGS84_FLATTENING * (2 - WGS84_FLATTENING)
GRS80_ES = 1.0 - (GRS80_MINOR / 6378137.0) ** 2
SINGLE_SCALE = 0.9995999932289124  # 0.9996 held in single precision by the UTM-33 grid

# fixed values: ellipsoidal Mercator
ELLIPSOID_E = 0.0818191908426
ELLIPSOID_HALF = 20037508.342789
ELLIPSOID_SCALE = 53.5865938
ELLIPSOID_SERIES = (
    0.00335655146887969, 0.00000657187271079536, 0.00000001764564338702, 0.00000000005328478445,
)


def _zoom(z: Zoom) -> Column:
    return F.lit(z) if isinstance(z, int) else col(z)


def _pow2(z: Zoom) -> Column:
    if isinstance(z, int):
        return F.lit(1 << z).cast("bigint")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _zoom(z).cast("int"))


def _lookup(values: tuple, z: Zoom) -> Column:
    """Per-zoom constant, NULL beyond the table."""
    if isinstance(z, int):
        return F.lit(values[z] if 0 <= z < len(values) else None).cast("double")
    return F.try_element_at(F.array(*[F.lit(float(v)) for v in values]), _zoom(z).cast("int") + 1)


def matrix_size(g: Grid, z: Zoom) -> tuple[Column, Column]:
    """Tiles across and down of a whole-world grid."""
    if g.kind in ("mercator", "ellipsoid", "utm33"):
        return _pow2(z), _pow2(z)
    if g.kind == "plate":
        return _pow2(z) * 2, _pow2(z)
    if g.kind == "swiss":
        return (
            _lookup(tuple(m[0] for m in g.matrix), z).cast("bigint"),
            _lookup(tuple(m[1] for m in g.matrix), z).cast("bigint"),
        )
    raise ValueError(f"{g.name} has no world matrix")


def _grid_metres(df: DataFrame, g: Grid, lat: Column, lng: Column) -> DataFrame:
    """Adds __gx, __gy: transverse Mercator metres of clipped degrees."""
    df = df.withColumns({"__cla": clip(lat, g.min_lat, g.max_lat), "__cln": clip(lng, g.min_lng, g.max_lng)})
    df = transverse.datum_shift(df, "__cla", "__cln", "__sla", "__sln", WGS84_MINOR, GRS80_MINOR)
    df = transverse.forward(
        df, F.radians("__sla"), F.radians("__sln") - g.meridian, "__gx", "__gy",
        GRS80_ES, g.scale, g.false_easting, g.false_northing,
    )
    return df.drop("__cla", "__cln", "__sla", "__sln")


def with_pixel(
    df: DataFrame,
    zoom: Zoom,
    crs: str = "mercator",
    lat: str = "lat",
    lng: str = "lng",
    x: str = "px",
    y: str = "py",
) -> DataFrame:
    """Adds the pixel position of each point at a zoom."""
    g = grid(crs)
    la, ln = col(lat), col(lng)
    cla, cln = clip(la, g.min_lat, g.max_lat), clip(ln, g.min_lng, g.max_lng)
    if g.kind in ("mercator", "swiss"):
        nx, ny = matrix_size(g, zoom)
        w, h = F.col("__w"), F.col("__h")
        s = F.col("__s")
        fx = (cln + 180) / 360
        fy = F.lit(0.5) - F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s)) / (4 * math.pi)
        return staged(
            df,
            {"__w": nx * g.tile, "__h": ny * g.tile, "__s": F.sin(cla * math.pi / 180)},
            {
                x: clip(fx * w + 0.5, 0.0, (w - 1).cast("double")).cast("bigint"),
                y: clip(fy * h + 0.5, 0.0, (h - 1).cast("double")).cast("bigint"),
            },
        )
    if g.kind == "ellipsoid":
        r = F.col("__r")
        e = ELLIPSOID_E
        ratio = F.tan(F.lit(math.pi / 4) + r / 2) / F.pow(
            F.tan(F.lit(math.pi / 4) + F.asin(F.sin(r) * e) / 2), F.lit(e)
        )
        shrink = F.pow(F.lit(2.0), F.lit(23.0) - _zoom(zoom))
        dx = (F.lit(ELLIPSOID_HALF) + F.radians(cln) * 6378137.0) * ELLIPSOID_SCALE / shrink
        dy = (F.lit(ELLIPSOID_HALF) - F.ln(F.col("__ratio")) * 6378137.0) * ELLIPSOID_SCALE / shrink
        return staged(
            df,
            {"__r": F.radians(cla)},
            {"__ratio": ratio},
            {x: dx.cast("bigint"), y: dy.cast("bigint")},
        )
    if g.kind == "plate":
        nx, _ = matrix_size(g, zoom)
        step = F.lit(360.0) / (nx * g.tile)
        return df.withColumns(
            {x: ((cln + 180) / step).cast("bigint"), y: ((F.lit(90.0) - cla) / step).cast("bigint")}
        )
    if g.kind == "plate_table":
        res = _lookup(g.resolutions, zoom)
        return df.withColumns(
            {x: F.floor((cln - g.origin_x) / res), y: F.floor((F.lit(g.origin_y) - cla) / res)}
        )
    if g.kind == "transverse":
        res = _lookup(g.resolutions, zoom)
        out = _grid_metres(df, g, la, ln)
        return out.withColumns(
            {
                x: F.floor((F.col("__gx") - g.origin_x) / res),
                y: F.floor((F.lit(g.origin_y) - F.col("__gy")) / res),
            }
        ).drop("__gx", "__gy")
    if g.kind == "utm33":
        out = transverse.redfearn_forward(
            df, F.radians(cla), F.radians(cln - 15.0), "__gx", "__gy", WGS84_ES, SINGLE_SCALE
        )
        back = F.lit(20) - _zoom(zoom)
        _, ny = matrix_size(g, zoom)
        gx = ((F.bround(F.round("__gx", 2)) + 3700000.0) * 32).cast("bigint")
        gy = ((F.bround(F.round("__gy", 2)) - 1300000.0) * 32).cast("bigint")
        return out.withColumns(
            {
                x: F.call_function("shiftright", gx, back.cast("int")),
                y: ny * 256 - F.call_function("shiftright", gy, back.cast("int")),
            }
        ).drop("__gx", "__gy")
    raise ValueError(g.kind)


def with_position(
    df: DataFrame,
    zoom: Zoom,
    crs: str = "mercator",
    x: str = "px",
    y: str = "py",
    lat: str = "lat",
    lng: str = "lng",
) -> DataFrame:
    """Adds degrees for a pixel position (the inverse of :func:`with_pixel`)."""
    g = grid(crs)
    cx, cy = col(x).cast("double"), col(y).cast("double")
    if g.kind in ("mercator", "swiss"):
        nx, ny = matrix_size(g, zoom)
        w, h = (nx * g.tile).cast("double"), (ny * g.tile).cast("double")
        fx = clip(cx, 0.0, w - 1) / w - 0.5
        fy = F.lit(0.5) - clip(cy, 0.0, h - 1) / h
        return df.withColumns(
            {lat: F.lit(90.0) - F.atan(F.exp(-fy * 2 * math.pi)) * 360 / math.pi, lng: fx * 360}
        )
    if g.kind == "ellipsoid":
        grow = F.pow(F.lit(2.0), F.lit(23.0) - _zoom(zoom))
        mx = cx * grow / ELLIPSOID_SCALE - ELLIPSOID_HALF
        my = F.lit(ELLIPSOID_HALF) - cy * grow / ELLIPSOID_SCALE
        p = F.col("__p")
        lat_r = p
        for i, k in enumerate(ELLIPSOID_SERIES, start=1):
            lat_r = lat_r + F.sin(p * (2 * i)) * k
        return staged(
            df,
            {"__p": F.lit(math.pi / 2) - F.atan(F.lit(1.0) / F.exp(my / 6378137.0)) * 2},
            {lat: F.degrees(lat_r), lng: F.degrees(mx / 6378137.0)},
        )
    if g.kind == "plate":
        nx, _ = matrix_size(g, zoom)
        step = F.lit(360.0) / (nx * g.tile)
        return df.withColumns({lat: F.lit(90.0) - cy * step, lng: cx * step - 180})
    if g.kind == "plate_table":
        res = _lookup(g.resolutions, zoom)
        return df.withColumns({lat: F.lit(g.origin_y) - cy * res, lng: cx * res + g.origin_x})
    if g.kind == "transverse":
        res = _lookup(g.resolutions, zoom)
        gx = cx * res + (g.origin_x - g.false_easting)
        gy = F.lit(g.origin_y - g.false_northing) - cy * res
        out = transverse.inverse(df, gx, gy, "__phi_o", "__lam_o", GRS80_ES, g.scale)
        out = out.withColumns(
            {"__dla": F.degrees("__phi_o"), "__dln": F.degrees(F.col("__lam_o") + g.meridian)}
        )
        out = transverse.datum_shift(out, "__dla", "__dln", "__ola", "__oln", GRS80_MINOR, GRS80_MINOR)
        return out.withColumns(
            {lat: clip(F.col("__ola"), g.min_lat, g.max_lat), lng: clip(F.col("__oln"), g.min_lng, g.max_lng)}
        ).drop("__phi_o", "__lam_o", "__dla", "__dln", "__ola", "__oln")
    if g.kind == "utm33":
        grow = F.pow(F.lit(2.0), F.lit(20.0) - _zoom(zoom))
        _, ny = matrix_size(g, zoom)
        east = F.round(cx * grow / 32 - 3700000.0, 2)
        north = F.round(((ny * 256).cast("double") - cy) * grow / 32 + 1300000.0, 2)
        out = transverse.redfearn_inverse(
            df, east - 500000.0, north, "__phi_o", "__lam_o", WGS84_ES, SINGLE_SCALE
        )
        return out.withColumns(
            {
                lat: clip(F.degrees("__phi_o"), g.min_lat, g.max_lat),
                lng: clip(F.degrees("__lam_o") + 15.0, g.min_lng, g.max_lng),
            }
        ).drop("__phi_o", "__lam_o")
    raise ValueError(g.kind)


def with_tile(
    df: DataFrame, zoom: Zoom, crs: str = "mercator", lat: str = "lat", lng: str = "lng",
    x: str = "tile_x", y: str = "tile_y",
) -> DataFrame:
    """Adds the tile holding each point."""
    g = grid(crs)
    out = with_pixel(df, zoom, crs, lat, lng, "__px", "__py")
    return out.withColumns(
        {x: pixel_to_tile(F.col("__px"), g.tile), y: pixel_to_tile(F.col("__py"), g.tile)}
    ).drop("__px", "__py")


def pixel_to_tile(p: Column, size: int = 256) -> Column:
    """Tile number of a pixel coordinate; grid sizes are powers of two."""
    return F.call_function("shiftright", p, F.lit(size.bit_length() - 1))


def tile_origin_pixel(x: Column, y: Column, size: int = 256) -> tuple[Column, Column]:
    return x * size, y * size


def ground_resolution(lat: Column | str, zoom: Zoom, crs: str = "mercator") -> Column:
    """Metres on the ground per pixel (degrees on the table grid)."""
    g = grid(crs)
    if g.kind in ("plate_table", "transverse"):
        return _lookup(g.resolutions, zoom)
    nx, _ = matrix_size(g, zoom)
    return F.cos(F.radians(num(lat))) * (2 * math.pi * g.axis) / (nx * g.tile)


def tile_matrix(spark: SparkSession, crs: str = "mercator", max_zoom: int = 20) -> DataFrame:
    """One row per zoom: corner tiles, matrix size, item count and pixel size."""
    g = grid(crs)
    top = max_zoom if not g.resolutions else min(max_zoom, len(g.resolutions) - 1)
    top = top if not g.matrix else min(top, len(g.matrix) - 1)
    z = spark.range(0, top + 1, 1, 1).select(F.col("id").cast("int").alias("zoom"))
    if g.kind == "utm33":
        low = F.when(F.col("zoom") > 3, F.floor(F.pow(F.lit(2.0), F.col("zoom") - 4)) * 3).otherwise(F.lit(1))
        high = _pow2("zoom") - F.floor(F.pow(F.lit(2.0), F.col("zoom") - 2))
        z = z.withColumns({c: low.cast("bigint") for c in ("min_x", "min_y")})
        z = z.withColumns({c: high.cast("bigint") for c in ("max_x", "max_y")})
    elif g.resolutions:
        z = z.withColumns({"__tla": F.lit(g.max_lat), "__tln": F.lit(g.min_lng),
                           "__bla": F.lit(g.min_lat), "__bln": F.lit(g.max_lng)})
        z = with_tile(z, "zoom", crs, "__tla", "__tln", "min_x", "min_y")
        z = with_tile(z, "zoom", crs, "__bla", "__bln", "max_x", "max_y").drop("__tla", "__tln", "__bla", "__bln")
    else:
        nx, ny = matrix_size(g, "zoom")
        zero = F.lit(0).cast("bigint")
        z = z.withColumns({"min_x": zero, "min_y": zero, "max_x": nx - 1, "max_y": ny - 1})
    if g.kind == "utm33":
        w, h = _pow2("zoom"), _pow2("zoom")
    else:
        w = F.col("max_x") - F.col("min_x") + 1
        h = F.col("max_y") - F.col("min_y") + 1
    z = z.withColumns({"size_x": w, "size_y": h})
    return z.withColumns(
        {
            "items": F.col("size_x") * F.col("size_y"),
            "pixels_x": F.col("size_x") * g.tile,
            "pixels_y": F.col("size_y") * g.tile,
        }
    )


def _explode_grid(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, x: str, y: str) -> DataFrame:
    """Cross the two integer ranges of a row; rows with an empty range vanish."""
    df = df.withColumns({"__x0": x0, "__x1": x1, "__y0": y0, "__y1": y1})
    df = df.filter((F.col("__x0") <= F.col("__x1")) & (F.col("__y0") <= F.col("__y1")))
    df = df.withColumn(x, F.explode(F.sequence("__x0", "__x1")))
    df = df.withColumn(y, F.explode(F.sequence("__y0", "__y1")))
    return df.drop("__x0", "__x1", "__y0", "__y1")


def tiles_for_area(
    df: DataFrame, zoom: Zoom, padding: int = 0, crs: str = "mercator", prefix: str = "r",
    x: str = "tile_x", y: str = "tile_y",
) -> DataFrame:
    """All tiles of a rectangle, ``padding`` tiles wider on each side, from 0 on."""
    out = with_tile(df, zoom, crs, f"{prefix}_top", f"{prefix}_left", "__ax", "__ay")
    out = with_tile(out, zoom, crs, f"{prefix}_bottom", f"{prefix}_right", "__bx", "__by")
    zero = F.lit(0).cast("bigint")
    out = _explode_grid(
        out,
        F.greatest(zero, F.col("__ax") - padding), F.col("__bx") + padding,
        F.greatest(zero, F.col("__ay") - padding), F.col("__by") + padding,
        x, y,
    )
    return out.drop("__ax", "__ay", "__bx", "__by")


def plan_tiles(df: DataFrame, tile_size: int = 256, x: str = "tile_x", y: str = "tile_y") -> DataFrame:
    """Tiles around a view: ``center_x center_y view_w view_h min_x min_y max_x
    max_y scale margin`` give the window; output adds pixel origin and the
    squared distance from the center."""
    m = F.greatest(F.col("margin"), F.lit(0)).cast("bigint")

    def reach(view: str) -> tuple[Column, Column]:
        span = F.col(view) * F.col("scale")
        return F.floor(-span) - m, F.ceil(span) + m

    lo_x, hi_x = reach("view_w")
    lo_y, hi_y = reach("view_h")
    cx, cy = F.col("center_x"), F.col("center_y")
    out = _explode_grid(
        df,
        F.greatest(cx + lo_x, F.col("min_x")), F.least(cx + hi_x, F.col("max_x")),
        F.greatest(cy + lo_y, F.col("min_y")), F.least(cy + hi_y, F.col("max_y")),
        x, y,
    )
    dx, dy = cx - F.col(x), cy - F.col(y)
    return out.withColumns(
        {"pixel_x": F.col(x) * tile_size, "pixel_y": F.col(y) * tile_size, "dist_sqr": dx * dx + dy * dy}
    )


def split_area_grid(df: DataFrame, step: float = 0.20, prefix: str = "r", out: str = "cell") -> DataFrame:
    """Rectangle rows to grid cells of ``step`` degrees; the last ones are trimmed.

    Cell starts are reached by repeated addition so that the edges are the same
    doubles a running sum gives.
    """
    p, o = prefix, out
    south = F.least(f"{p}_bottom", f"{p}_top")
    north = F.greatest(f"{p}_bottom", f"{p}_top")
    west = F.least(f"{p}_left", f"{p}_right")
    east = F.greatest(f"{p}_left", f"{p}_right")

    def starts(low: Column, high: Column) -> Column:
        n = F.ceil((high - low) / step).cast("int") + 1
        steps = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        run = F.aggregate(
            steps,
            F.array(low),
            lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) + step)),
        )
        return F.filter(run, lambda v: v < high)

    df = df.withColumn(f"{o}_bottom", F.explode(starts(south, north)))
    df = df.withColumn(f"{o}_left", F.explode(starts(west, east)))
    return df.withColumns(
        {
            f"{o}_top": F.least(F.col(f"{o}_bottom") + step, north),
            f"{o}_right": F.least(F.col(f"{o}_left") + step, east),
        }
    )


def tile_bbox(
    df: DataFrame, zoom: Zoom, crs: str = "mercator", x: str = "tile_x", y: str = "tile_y", prefix: str = "t"
) -> DataFrame:
    """Degrees of a tile's corners."""
    size = grid(crs).tile
    df = df.withColumns(
        {"__ax": F.col(x) * size, "__ay": F.col(y) * size,
         "__bx": (F.col(x) + 1) * size, "__by": (F.col(y) + 1) * size}
    )
    df = with_position(df, zoom, crs, "__ax", "__ay", f"{prefix}_top", f"{prefix}_left")
    df = with_position(df, zoom, crs, "__bx", "__by", f"{prefix}_bottom", f"{prefix}_right")
    return df.drop("__ax", "__ay", "__bx", "__by")


def quadkey(x: Column | str, y: Column | str, zoom: Column | str | int) -> Column:
    """Base-4 text of a tile: one digit per zoom level, coarsest first."""
    z = _zoom(zoom)

    def digit(i: Column) -> Column:
        shift = (z - i).cast("int")
        bx = F.call_function("shiftright", col(x), shift).bitwiseAND(F.lit(1).cast("bigint"))
        by = F.call_function("shiftright", col(y), shift).bitwiseAND(F.lit(1).cast("bigint"))
        return (bx + by * 2).cast("string")

    return F.when(z > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(z, F.lit(1))), digit), "")).otherwise("")


def quadkey_to_tile(key: Column | str) -> Column:
    """Struct (x, y, zoom) of a quadkey; digits are read as one base-4 number."""
    k = col(key)

    def axis(bit: int) -> Column:
        digits = "0101" if bit == 0 else "0011"
        return F.coalesce(F.conv(F.when(k != "", F.translate(k, "0123", digits)), 2, 10), F.lit("0")).cast("bigint")

    return F.struct(axis(0).alias("x"), axis(1).alias("y"), F.length(k).alias("zoom"))


def flip_tile_y(y: Column | str, zoom: Zoom) -> Column:
    """Row number counted from the other edge."""
    return _pow2(zoom) - 1 - col(y)


def tile_shard(x: Column | str, y: Column | str, n: int) -> Column:
    """Even work split by position: (x + 2y) mod n."""
    return F.pmod(col(x) + col(y) * 2, F.lit(n).cast("bigint"))


def tile_shard_16(x: Column | str, y: Column | str) -> Column:
    return F.pmod(col(x), F.lit(4)) + F.pmod(col(y), F.lit(4)) * 4


def fit_zoom(
    df: DataFrame, view_w: int, view_h: int, min_zoom: int, max_zoom: int,
    crs: str = "mercator", prefix: str = "r", out: str = "fit_zoom",
) -> DataFrame:
    """Deepest zoom of the leading run of zooms at which a rectangle fits a view.

    The zoom range is a constant handful, so each row tests its levels in place.
    """
    slack = 10
    names = []
    for z in range(min_zoom, max_zoom + 1):
        df = with_pixel(df, z, crs, f"{prefix}_top", f"{prefix}_left", "__ax", "__ay")
        df = with_pixel(df, z, crs, f"{prefix}_bottom", f"{prefix}_right", "__bx", "__by")
        name = f"__fit{z}"
        df = df.withColumn(
            name,
            (F.col("__bx") - F.col("__ax") <= view_w + slack) & (F.col("__by") - F.col("__ay") <= view_h + slack),
        ).drop("__ax", "__ay", "__bx", "__by")
        names.append((z, name))
    found = F.lit(max_zoom)
    for z, name in reversed(names):
        found = F.when(~F.col(name), F.lit(max(z - 1, min_zoom))).otherwise(found)
    flat = (F.col(f"{prefix}_top") == F.col(f"{prefix}_bottom")) | (
        F.col(f"{prefix}_left") == F.col(f"{prefix}_right")
    )
    return df.withColumn(out, F.when(flat, F.lit(max_zoom // 2)).otherwise(found)).drop(*[n for _, n in names])


def required_zoom(
    zoom: Column | float, view_w: Column, view_h: Column, area_w: Column, area_h: Column, min_zoom: float
) -> Column:
    """Fractional zoom at which a visible span fits inside an area."""
    ok = (view_w > 0) & (view_h > 0) & (area_w > 0) & (area_h > 0)
    need = num(zoom) + F.log2(F.greatest(view_w / area_w, view_h / area_h))
    return F.when(ok, F.greatest(F.lit(float(min_zoom)), need)).otherwise(F.lit(float(min_zoom)))


def required_zoom_ceiling(required: Column, min_zoom: int) -> Column:
    return F.greatest(F.lit(min_zoom), F.ceil(required - 1e-9).cast("int"))


def zoom_range_filter(df: DataFrame, low: int, high: int, zoom: str = "zoom") -> DataFrame:
    return df.filter(F.col(zoom).between(low, high))


def tile_histogram(df: DataFrame, zoom: int, crs: str = "mercator") -> DataFrame:
    """Points per tile; counted before the shuffle, so a crowded tile is one row
    per task."""
    return (
        with_tile(df, zoom, crs).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n")).withColumn("zoom", F.lit(zoom))
    )
