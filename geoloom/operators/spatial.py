"""Spatial joins: points with polygons, nearest segments and areas.

Every join is an equi-join on grid cells followed by an exact test. Polygons
take the finest grid level at which they touch at most 25 cells, points are looked
up on each level in use, so a pair meets in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from geoloom.functions import rings as G
from geoloom.functions.core import beside_one_row
from geoloom.operators.skew import skew_join
from geoloom.operators.utm import utm_zone, with_utm
from geoloom.session import cut_lineage

BASE_CELL = 1000.0
LEVEL_FACTOR = 4.0
MAX_LEVEL = 8  # 1 km .. 65,000 km
CELLS_PER_SIDE = 4.0  # finer covers repeat polygon rows but spare many more point pairs
MAX_COVER_ROWS = 4_000_000  # of long segments cut into cells, more are not put through a shuffle
MAX_DISC_ROWS = 300_000  # broadcast at once


def level_size(level: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(LEVEL_FACTOR), level)


def with_cover(
    df: DataFrame, min_x: Column, min_y: Column, max_x: Column, max_y: Column, base: float = BASE_CELL
) -> DataFrame:
    """One row per grid cell of a box: adds ``__level __cx __cy``."""
    span = F.greatest(max_x - min_x, max_y - min_y)
    level = F.greatest(
        F.lit(0), F.least(F.lit(MAX_LEVEL), F.ceil(F.log(F.greatest(span / (base * CELLS_PER_SIDE), F.lit(1e-9))) / F.log(F.lit(LEVEL_FACTOR))).cast("int"))
    )
    df = df.withColumn("__level", level)
    size = level_size(F.col("__level"), base)
    df = df.withColumns(
        {
            "__cx": F.explode(F.sequence(F.floor(min_x / size), F.floor(max_x / size))),
        }
    )
    return df.withColumn("__cy", F.explode(F.sequence(F.floor(min_y / size), F.floor(max_y / size))))


def with_point_cells(df: DataFrame, levels: DataFrame, x: str, y: str, base: float = BASE_CELL) -> DataFrame:
    """One row per level in use; ``levels`` has at most MAX_LEVEL + 1 rows."""
    df = df.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL))))
    df = df.join(F.broadcast(levels), "__level", "left_semi")
    size = level_size(F.col("__level"), base)
    return df.withColumns({"__cx": F.floor(F.col(x) / size), "__cy": F.floor(F.col(y) / size)})


def pairs_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    on: Sequence[str] = (),
    x: str = "x",
    y: str = "y",
    outer: str = "outer",
    holes: str = "holes",
    base: float = BASE_CELL,
    slack: float = 1e-6,
) -> DataFrame:
    """Point rows joined to every polygon row that contains them.

    ``on`` names equality keys that must match too (such as the UTM zone).
    Column names of the two sides must differ apart from ``on``.
    """
    box = dict(zip(("__x0", "__y0", "__x1", "__y1"), ("min_x", "min_y", "max_x", "max_y")))
    # polygons of few vertices and one hole at most are tested on plain columns, others in a loop over their edges
    hole = F.get(F.col(holes), F.lit(0))
    small = G.is_small_ring(F.col(outer)) & ((F.size(holes) == 0) | ((F.size(holes) == 1) & G.is_small_ring(hole)))
    flat = {**G.flat_ring(F.col(outer), "__o"), **G.flat_ring(hole, "__h")}
    boxed = polygons.withColumns({c: G.bounding(outer)[side] for c, side in box.items()})
    boxed = boxed.withColumns({"__small": F.coalesce(small, F.lit(False)), **flat})
    cells = with_cover(boxed, *[F.col(c) for c in box], base=base)
    levels = cells.select("__level").distinct()
    located = with_point_cells(points, levels, x, y, base)
    joined = skew_join(located, cells, [*on, "__level", "__cx", "__cy"])
    px, py = F.col(x), F.col(y)
    in_box = px.between(F.col("__x0"), F.col("__x1")) & py.between(F.col("__y0"), F.col("__y1"))
    in_small = G.point_in_flat_ring(x, y, "__o", slack) & ~G.point_in_flat_ring(x, y, "__h", slack)
    inside = F.when(F.col("__small"), in_small).otherwise(G.point_in_polygon(x, y, outer, holes, slack))
    return joined.filter(in_box & inside).drop("__level", "__cx", "__cy", "__small", *box, *flat)


def with_nearby_zones(
    df: DataFrame, lat: str = "lat", lng: str = "lng", margin_deg: float = 3.0, x: str = "x", y: str = "y",
    zone: str = "utm_zone", band: str = "utm_band",
) -> DataFrame:
    """Each point in its own UTM zone and in a neighbour zone when it lies within
    ``margin_deg`` of the common edge."""
    own = utm_zone(lng)
    west = F.col(lng) + 180 - (own - 1) * 6.0
    zones = F.filter(
        F.array(
            own,
            F.when(west <= margin_deg, F.when(own == 1, F.lit(60)).otherwise(own - 1)),
            F.when(west >= 6.0 - margin_deg, F.when(own == 60, F.lit(1)).otherwise(own + 1)),
        ),
        lambda z: z.isNotNull(),
    )
    out = df.withColumn("__try_zone", F.explode(F.array_distinct(zones)))
    return with_utm(out, F.col("__try_zone"), lat, lng, x, y, zone, band).drop("__try_zone")


def zone_bounds(shapes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, zone: str = "utm_zone") -> DataFrame:
    """The UTM zones in use with the box of all that lies in each: at most 60 rows."""
    known = shapes.filter(F.col(zone).between(1, 60))
    return known.groupBy(F.col(zone).cast("int").alias("__try_zone")).agg(
        F.min(x0).alias("__zx0"), F.min(y0).alias("__zy0"), F.max(x1).alias("__zx1"), F.max(y1).alias("__zy1")
    )


def with_zones_in_use(points: DataFrame, bounds: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Each point once in every zone of :func:`zone_bounds`, however far away, with the zone's box."""
    tried = points.withColumn("__try_zone", F.explode(F.sequence(F.lit(1), F.lit(60))))
    tried = tried.join(F.broadcast(bounds), "__try_zone")
    return with_utm(tried, F.col("__try_zone"), lat, lng, "x", "y").drop("__try_zone")


def segments_of(polygons: DataFrame, keep: Sequence[str], outer: str = "outer", holes: str = "holes") -> DataFrame:
    """Boundary edges of polygons, one row each: ``keep`` plus ax ay bx by."""
    all_rings = F.concat(F.array(F.col(outer)), F.coalesce(F.col(holes), F.array().cast(f"array<{G.RING}>")))
    edges = F.flatten(F.transform(all_rings, lambda r: G.corners(r)))
    return polygons.select(*keep, F.explode(edges).alias("__e")).select(*keep, "__e.*")


def nearest_segments(
    points: DataFrame,
    segments: DataFrame,
    point_id: str,
    candidate: Sequence[str],
    on: Sequence[str] = (),
    x: str = "x",
    y: str = "y",
    start: float = 2000.0,
    max_distance: float | None = None,
    cover_rows: int = MAX_COVER_ROWS,
) -> DataFrame:
    """For each point the nearest segment (ax ay bx by; a place is a segment of
    length zero): ``point_id``, the candidate columns and ``distance_m``. Ties go to
    the smallest candidate columns in their order.

    ``points`` may hold a point more than once, under several ``on`` keys (such as the UTM
    zones in use); its nearest segment over all of them counts. A point without finite
    coordinates, or without any candidate under its keys, gets no row.

    Rounds of growing cells: a cell and its eight neighbours cover every segment within one
    cell size, so a best distance up to that size is final; only the other points go on to
    the next round. A point takes part in a round only under keys whose segments have a
    bounding box within the cell size, and rounds in which no point does are left out.
    Copies of one location are taken as one candidate first. Segments so long that their cells
    are more than ``cover_rows``, and more than eight a segment, are searched by :func:`_nearest_by_bounds`.
    """
    place = ["ax", "ay", "bx", "by"]
    finite = [F.abs(F.col(c)) < float("inf") for c in place]
    unique = segments.filter(reduce(and_, finite)).groupBy(*on, *place).agg(F.min(F.struct(*candidate)).alias("__cand"))
    unique = cut_lineage(unique)  # every round reads it
    box = unique.groupBy(*on).agg(
        F.min(F.least("ax", "bx")).alias("__lx"), F.min(F.least("ay", "by")).alias("__ly"),
        F.max(F.greatest("ax", "bx")).alias("__hx"), F.max(F.greatest("ay", "by")).alias("__hy"),
    )
    left = points.select(point_id, *on, x, y).filter((F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf")))
    left = left.join(box, list(on)) if on else beside_one_row(left, box)
    beyond = (
        F.greatest(F.col("__lx") - F.col(x), F.col(x) - F.col("__hx"), F.lit(0.0)),
        F.greatest(F.col("__ly") - F.col(y), F.col(y) - F.col("__hy"), F.lit(0.0)),
    )
    left = left.withColumn("__gap", F.hypot(*beyond)).filter("__gap IS NOT NULL").drop("__lx", "__ly", "__hx", "__hy")
    if max_distance is not None:
        left = left.filter(F.col("__gap") <= max_distance)
    left = cut_lineage(left)
    done: DataFrame | None = None
    size = start
    while True:
        nearest_box = left.agg(F.min("__gap")).first()[0]
        if nearest_box is None:
            return done if done is not None else _no_nearest(points, unique, point_id)
        while size < nearest_box and (max_distance is None or size < max_distance):
            size *= LEVEL_FACTOR
        cell = F.lit(size)
        # long segments are cut into pieces no longer than a cell before covering
        pieces = F.greatest(
            F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / cell).cast("int")
        )
        if done is None and size == start:
            rows, many = unique.agg(F.sum(pieces.cast("long")), F.count(F.lit(1))).first()
            if rows > max(cover_rows, 8 * many):
                return _nearest_by_bounds(left.drop("__gap"), unique, point_id, candidate, on, x, y, max_distance, many, cover_rows)
        cut = unique.withColumn("__k", pieces).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
        f0, f1 = F.col("__i") / F.col("__k"), (F.col("__i") + 1) / F.col("__k")

        def along(f: Column, a: str, b: str) -> Column:
            return F.col(a) + (F.col(b) - F.col(a)) * f

        xs, ys = (along(f0, "ax", "bx"), along(f1, "ax", "bx")), (along(f0, "ay", "by"), along(f1, "ay", "by"))
        cover = cut.withColumn("__cx", F.explode(F.sequence(F.floor(F.least(*xs) / cell), F.floor(F.greatest(*xs) / cell))))
        cover = cover.withColumn("__cy", F.explode(F.sequence(F.floor(F.least(*ys) / cell), F.floor(F.greatest(*ys) / cell))))
        cover = cover.select(*on, *place, "__cand", "__cx", "__cy").distinct()
        around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        near = left.filter(F.col("__gap") <= size).drop("__gap")
        near = near.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
        near = near.withColumns(
            {"__cx": F.floor(F.col(x) / cell) + F.col("__dx"), "__cy": F.floor(F.col(y) / cell) + F.col("__dy")}
        ).drop("__dx", "__dy")
        met = skew_join(near, cover, [*on, "__cx", "__cy"])
        d = G.segment_distance(F.col(x), F.col(y), *[F.col(c) for c in place])
        best = met.groupBy(point_id).agg(F.min(F.struct(d.alias("distance_m"), F.col("__cand"))).alias("__b"))
        final_round = max_distance is not None and size >= max_distance
        bound = size if max_distance is None else min(size, max_distance)
        settled = cut_lineage(best.filter(F.col("__b.distance_m") <= bound).select(point_id, "__b.distance_m", "__b.__cand.*"))
        done = settled if done is None else done.unionByName(settled)
        if final_round:
            return done
        left = cut_lineage(_others(left, settled, point_id))
        size *= LEVEL_FACTOR


def _others(points: DataFrame, settled: DataFrame, point_id: str) -> DataFrame:
    """Points that are not settled; those without a name are one point."""
    return points.join(settled.select(F.col(point_id).alias("__settled")), F.col(point_id).eqNullSafe(F.col("__settled")), "left_anti")


def with_segment_cells(segments: DataFrame, sizes: dict[int, float], box: Sequence[float]) -> DataFrame:
    """One row per cell that a segment (ax ay bx by) touches, on each level of ``sizes``: adds ``__cell``.
    Cells beyond the ``box`` (least and greatest x, least and greatest y) may be left out."""
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("l"), F.lit(c).alias("c")) for i, c in sizes.items()]))
    steep = F.abs(F.col("by") - F.col("ay")) > F.abs(F.col("bx") - F.col("ax"))
    turned = {"__ua": F.when(steep, F.col("ay")).otherwise(F.col("ax")), "__va": F.when(steep, F.col("ax")).otherwise(F.col("ay"))}
    turned |= {"__ub": F.when(steep, F.col("by")).otherwise(F.col("bx")), "__vb": F.when(steep, F.col("bx")).otherwise(F.col("by"))}
    # along the longer side, from its lower end: column by column
    forth = F.col("__ua") <= F.col("__ub")
    s = segments.withColumns({"__steep": steep, **turned}).withColumns({
        "__u0": F.least("__ua", "__ub"), "__u1": F.greatest("__ua", "__ub"), "__v0": F.when(forth, F.col("__va")).otherwise(F.col("__vb")),
        "__slope": F.when(F.col("__ua") == F.col("__ub"), 0.0).otherwise((F.col("__vb") - F.col("__va")) / (F.col("__ub") - F.col("__ua"))),
    })
    low, high = (F.when(F.col("__steep"), F.lit(float(b))).otherwise(F.lit(float(a))) for a, b in zip(box[:2], box[2:]))
    s = s.filter((F.col("__u1") >= low) & (F.col("__u0") <= high)).withColumn("__at", level)
    cell = F.col("__at.c")
    s = s.withColumn("__cu", F.explode(F.sequence(F.floor(F.greatest(F.col("__u0"), low) / cell), F.floor(F.least(F.col("__u1"), high) / cell))))
    ends = [F.greatest("__u0", F.col("__cu") * cell), F.least(F.col("__u1"), (F.col("__cu") + 1) * cell)]
    p, q = (F.col("__v0") + (u - F.col("__u0")) * F.col("__slope") for u in ends)
    slack = 1e-6 + 1e-9 * (F.abs(F.col("__u0")) + F.abs(F.col("__u1")) + F.abs(F.col("__v0")))
    s = s.withColumn("__cv", F.explode(F.sequence(F.floor((F.least(p, q) - slack) / cell), F.floor((F.greatest(p, q) + slack) / cell))))
    cx, cy = (F.when(F.col("__steep") == flip, F.col("__cv")).otherwise(F.col("__cu")) for flip in (True, False))
    return s.withColumn("__cell", F.xxhash64(F.col("__at.l"), cx, cy)).select(*segments.columns, "__cell")


def _nearest_by_bounds(
    points: DataFrame, unique: DataFrame, point_id: str, candidate: Sequence[str], on: Sequence[str], x: str, y: str,
    max_distance: float | None, many: int, cover_rows: int,
) -> DataFrame:
    """:func:`nearest_segments` where segments are long against the distances.

    The distance of a spot to any segment bounds its nearest one. Bounds come from 64 segments, then from
    32 times as many, until all segments have been tried: in each stage a spot meets only what crosses the
    cells of the disc within its bound, some multiple of 32 segments. The cells of many segments are not
    shuffled; the discs are broadcast to them, at most ``MAX_DISC_ROWS`` at once, and only pairs within
    the bound go on.
    """
    place, spot = ["ax", "ay", "bx", "by"], [*on, x, y]
    d = G.segment_distance(F.col(x), F.col(y), *[F.col(c) for c in place])
    spots = points.select(*spot).distinct()
    some = unique.groupBy(*on).agg(F.min(F.struct(*place, "__cand")).alias("__s")).select(*on, "__s.*")
    spots = spots.join(some, list(on)) if on else beside_one_row(spots, some)
    spots = cut_lineage(spots.select(*spot, d.alias("__d"), "__cand"))
    n, x0, x1, y0, y1 = spots.agg(F.count(F.lit(1)), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    # about one spot a cell
    base = max(1.0, (max(x1 - x0, 1.0) * max(y1 - y0, 1.0) / max(n, 1)) ** 0.5)
    within = F.col("__d") if max_distance is None else F.least(F.col("__d"), F.lit(float(max_distance)))
    longest = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    pieces = unique.agg(F.sum(longest / base + 1)).first()[0]
    tried = 64
    while True:
        whole = tried * 4 >= many
        share = 1.0 if whole else tried / many
        part = unique if whole else unique.filter(F.pmod(F.xxhash64(*on, *place), F.lit(1 << 40)) < int(share * (1 << 40)))
        level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("__r"), F.lit(1e-9)) / base) / F.log(F.lit(LEVEL_FACTOR)))).cast("int")
        bounded = spots.withColumn("__r", within).withColumn("__l", level)
        far = bounded.groupBy("__l").agg(F.max("__r")).collect()
        sizes, margin = {r[0]: base * LEVEL_FACTOR ** r[0] for r in far}, max((r[1] for r in far), default=0.0) + 1.0
        cell, reach = level_size(F.col("__l"), base), F.col("__r") * (1 + 1e-9) + 1e-6
        discs = bounded
        for name, at in (("__cx", F.col(x)), ("__cy", F.col(y))):
            discs = discs.withColumn(name, F.explode(F.sequence(F.floor((at - reach) / cell), F.floor((at + reach) / cell))))
        discs = discs.select(*spot, "__r", F.xxhash64("__l", "__cx", "__cy").alias("__cell"))
        cover = with_segment_cells(part, sizes, (x0 - margin, x1 + margin, y0 - margin, y1 + margin))
        if pieces * share <= cover_rows:
            met = skew_join(discs, cover, [*on, "__cell"])
        else:
            rounds = -(-discs.count() // MAX_DISC_ROWS)
            turn = F.pmod(F.xxhash64(F.col("__cell"), F.lit(1)), F.lit(rounds))
            met = reduce(DataFrame.unionByName, [cover.join(F.broadcast(discs.filter(turn == i)), [*on, "__cell"]) for i in range(rounds)])
        met = met.withColumn("__d", d).filter(F.col("__d") <= F.col("__r"))
        if len(candidate) == 1:  # a plain column has its least value found without sorting
            met = met.groupBy(*spot, "__d").agg(F.min(F.col("__cand")[candidate[0]]).alias(candidate[0]))
            met = met.withColumn("__cand", F.struct(candidate[0]))
        both = met.select(*spot, "__d", "__cand").unionByName(spots)
        spots = cut_lineage(both.groupBy(*spot).agg(F.min(F.struct("__d", "__cand")).alias("__b")).select(*spot, "__b.*"))
        if whole:
            break
        tried *= 32
    best = points.join(spots, spot).groupBy(point_id).agg(F.min(F.struct(F.col("__d").alias("distance_m"), "__cand")).alias("__b"))
    found = best.select(point_id, "__b.distance_m", "__b.__cand.*")
    return cut_lineage(found if max_distance is None else found.filter(F.col("distance_m") <= max_distance))


def _no_nearest(points: DataFrame, unique: DataFrame, point_id: str) -> DataFrame:
    empty = points.select(point_id).limit(0).withColumn("distance_m", F.lit(0.0)).withColumn("__one", F.lit(1))
    return empty.join(unique.select("__cand.*").withColumn("__one", F.lit(1)), "__one").drop("__one")


def locate_points(
    points: DataFrame,
    polygons: DataFrame,
    centers: DataFrame,
    point_id: str = "point_id",
    place_id: str = "place_id",
    lat: str = "lat",
    lng: str = "lng",
) -> DataFrame:
    """The place of each point: the containing polygon with the least net area,
    otherwise the nearest polygon edge or, for places without polygon, center. A point is
    projected into every zone that holds places, so distance and zones set no limit.

    ``polygons``: place_id, utm_zone, outer, holes (chosen rings only).
    ``centers``: place_id, utm_zone, x, y of places that have no polygon.
    """
    from geoloom.operators import shape_tiles as T

    shapes = polygons.select(
        F.col(place_id).alias("__place"), "utm_zone", "outer", "holes", G.net_area("outer", "holes").alias("__area")
    )
    # a number that rises with area and place: the least one is found without sorting the pairs
    shapes = shapes.orderBy("__area", "__place").withColumn("__rank", F.monotonically_increasing_id())
    shapes = cut_lineage(T.with_box(shapes.withColumns({"polygons": F.array(T.rings_of()), "regular": T.is_regular(T.rings_of()) & F.col("utm_zone").isNotNull()})))
    edges = segments_of(shapes, ["__place", "utm_zone"])
    dots = centers.select(
        F.col(place_id).alias("__place"), "utm_zone", F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.col("x").alias("bx"), F.col("y").alias("by"),
    )
    everything = edges.unionByName(dots)
    used = cut_lineage(zone_bounds(everything, F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")))
    kind = points.schema[point_id].dataType
    whole = isinstance(kind, IntegralType)
    ref = F.col(point_id).cast("bigint") if whole else F.monotonically_increasing_id()
    zoned = with_zones_in_use(points.select(point_id, lat, lng, ref.alias("point_ref")), used, lat, lng)
    bounds = ["__zx0", "__zy0", "__zx1", "__zy1"]
    zoned = cut_lineage(zoned.select(*dict.fromkeys([point_id, "point_ref"]), "utm_zone", "x", "y", *bounds))
    slack = F.lit(1.0)
    boxed = F.col("x").between(F.col("__zx0") - slack, F.col("__zx1") + slack) & F.col("y").between(F.col("__zy0") - slack, F.col("__zy1") + slack)
    # each point goes through the polygons from the least one on, until one holds it; broken polygons and nameless points meet in pairs
    inner, named, broken = zoned.filter(boxed), F.col("point_ref").isNotNull(), shapes.filter("NOT regular")
    tiled = T.in_tiles(inner.filter(named), shapes.filter("regular").withColumnRenamed("__rank", "shape_ref"), T.least_shape, "point_ref bigint, shape_ref bigint")
    tiled = tiled.groupBy("point_ref").agg(F.min("shape_ref").alias("__rank"))
    if not whole:
        tiled = tiled.join(zoned.select("point_ref", point_id).distinct(), "point_ref")
    hits = tiled.select((F.col("point_ref").cast(kind) if whole else F.col(point_id)).alias(point_id), "__rank")
    for spots, held in ((inner, broken), (inner.filter(~named), shapes.filter("regular"))):
        if not spots.isEmpty() and not held.isEmpty():
            hits = hits.unionByName(pairs_in_polygons(spots.select(point_id, "utm_zone", "x", "y"), held.drop("polygons"), ["utm_zone"]).select(point_id, "__rank"))
    inside = hits.groupBy(point_id).agg(F.min("__rank").alias("__rank")).join(shapes.select("__rank", "__place"), "__rank")
    inside = inside.select(
        point_id, F.col("__place").alias(place_id), F.lit(0.0).alias("distance_m"), F.lit(True).alias("inside")
    )
    inside = cut_lineage(inside)
    rest = _others(zoned.select(point_id, "utm_zone", "x", "y"), inside, point_id)
    near = nearest_segments(rest, everything, point_id, ["__place"], ["utm_zone"])
    return inside.unionByName(
        near.select(point_id, F.col("__place").alias(place_id), "distance_m", F.lit(False).alias("inside"))
    )


def nearest_places(
    points: DataFrame, centers: DataFrame, max_distance: float, point_id: str = "point_id", place_id: str = "place_id",
    on: Sequence[str] = (),
) -> DataFrame:
    """Nearest center within a limit; points without one are left out."""
    dots = centers.select(
        F.col(place_id), *on, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by")
    )
    return nearest_segments(
        points, dots, point_id, [place_id], on, start=min(2000.0, max_distance), max_distance=max_distance
    )


def distance_to_routes(
    points: DataFrame, legs: DataFrame, point_id: str, route_id: str, max_distance: float | None = None, on: Sequence[str] = ()
) -> DataFrame:
    """Nearest route of each point and its distance (to the legs, clamped)."""
    return nearest_segments(points, legs, point_id, [route_id], on, max_distance=max_distance)


def points_in_areas(points: DataFrame, areas: DataFrame, area_id: str, prefix: str = "r", lat: str = "lat", lng: str = "lng", base: float = 0.05) -> DataFrame:
    """Points of each work area (closed bounds), through a cell join: areas may be
    many, so neither side is broadcast by hand."""
    from geoloom.functions.rects import in_bounds, rect

    r = rect(prefix)
    cells = with_cover(areas, r.left, r.bottom, r.right, r.top, base=base)
    levels = cells.select("__level").distinct()
    located = with_point_cells(points, levels, lng, lat, base)
    joined = skew_join(located, cells, ["__level", "__cx", "__cy"])
    return joined.filter(in_bounds(lat, lng, r, "closed")).drop("__level", "__cx", "__cy")
