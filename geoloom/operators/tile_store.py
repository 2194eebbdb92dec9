"""Maintenance of large tile tables keyed by (type, zoom, x, y)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("type", "zoom", "x", "y")


def export_new_tiles(source: DataFrame, destination: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Source rows whose key the destination does not hold; append them there."""
    return source.join(destination.select(*key), list(key), "left_anti")


def tiles_missing(planned: DataFrame, held: DataFrame, key: Sequence[str] = ("zoom", "x", "y")) -> DataFrame:
    return planned.join(held.select(*key), list(key), "left_anti")


def expire_rows(df: DataFrame, older_than: Column, tile_type: int | None = None, cached: str = "cached_at") -> DataFrame:
    """The rows that stay: expired ones are older than the date (and of the type,
    when given). Rows without a time stay."""
    gone = F.col(cached) < older_than
    if tile_type is not None:
        gone &= F.col("type") == tile_type
    return df.filter(~F.coalesce(gone, F.lit(False)))


def rewrite_without_expired(spark, path: str, target: str, older_than: Column, tile_type: int | None = None) -> None:
    """Write the surviving rows of a store to a new folder, one sub-folder per zoom."""
    keep = expire_rows(spark.read.parquet(path), older_than, tile_type)
    write_tile_store(keep, target, mode="overwrite")


def lookup_tiles(
    requests: DataFrame, stores: Sequence[tuple[str, DataFrame]], value: str = "tile", key: Sequence[str] = KEY,
    order: str = "cached_at",
) -> DataFrame:
    """Each request with the tile of the first store that holds it and that
    store's name; a store that holds a key twice gives its oldest row.

    The store and time of the winner are found without the tiles, among requested keys only;
    then the winner's tile is fetched. Where few keys are requested, no tile but theirs is
    shuffled. Rows of one store with equal times give the least tile.
    """
    held = None
    for rank, (name, store) in enumerate(stores):
        part = store.select(
            *key, F.lit(rank).alias("__rank"), F.lit(name).alias("source"), F.col(order).alias("__at"), F.col(value)
        )
        held = part if held is None else held.unionByName(part)
    wanted = requests.select(*key).distinct()
    best = held.drop(value, "source").join(wanted, list(key), "left_semi")
    best = best.groupBy(*key).agg(F.min(F.struct("__rank", "__at")).alias("__b"))
    won = held.join(best, list(key)).filter(F.struct("__rank", "__at").eqNullSafe(F.col("__b")))
    found = won.groupBy(*key).agg(F.first("source").alias("source"), F.min(value).alias(value))
    return requests.join(found, list(key), "left")


def union_stores(*stores: DataFrame) -> DataFrame:
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out.distinct()


def tile_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("tiles"))


def zoom_extent(df: DataFrame) -> DataFrame:
    return df.agg(F.min("zoom").alias("min_zoom"), F.max("zoom").alias("max_zoom"))


def store_size(df: DataFrame, tile: str = "tile") -> DataFrame:
    return df.agg(F.sum(F.octet_length(tile).cast("bigint")).alias("bytes"))


def evict_oldest(
    df: DataFrame, cap_bytes: int, order: Sequence[str] = ("cached_at", "id"), size: str = "bytes",
    bucket: Column | None = None, finer: Sequence[Column] = (),
) -> DataFrame:
    """Rows that stay when the oldest are dropped until the rest fits the cap.

    Sizes are summed per time bucket first. Buckets newer than the one the cap falls in
    stay whole, older ones go; that one is divided by the next of the ``finer`` buckets, and so on.
    Only rows of the last bucket found are put in order, so the finest bucket bounds what
    one task sorts, whatever its share of the store. Buckets must follow ``order``: a day in a
    month, then a range of ids in a day. Rows without a time are the oldest of all and go first.
    """
    first = F.date_trunc("hour", F.col(order[0])) if bucket is None else bucket
    edge, kept = df.withColumn("__base", F.lit(0).cast("bigint")), []
    newest_first = W.orderBy(F.col("__of").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    for level in (first, *finer):
        rows = edge.withColumn("__b", level)
        # one row per bucket: the ordered pass is over totals, not tiles
        totals = rows.groupBy(F.col("__b").alias("__of")).agg(F.sum(size).alias("__sum"), F.max("__base").alias("__start"))
        totals = totals.withColumn("__through", F.col("__start") + F.sum("__sum").over(newest_first))
        totals = totals.select("__of", "__through", (F.col("__through") - F.col("__sum")).alias("__before"))
        placed = rows.drop("__base").join(totals, F.col("__b").eqNullSafe(F.col("__of")))
        kept.append(placed.filter(F.col("__through") <= cap_bytes).select(df.columns))
        edge = placed.filter((F.col("__through") > cap_bytes) & (F.col("__before") <= cap_bytes))
        edge = edge.select(*df.columns, F.col("__before").alias("__base"))
    w = W.partitionBy("__base").orderBy(*[F.col(c).desc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    kept.append(edge.withColumn("__run", F.col("__base") + F.sum(size).over(w)).filter(F.col("__run") <= cap_bytes).select(df.columns))
    return reduce(DataFrame.unionByName, kept)


def read_tile_store(spark, path: str, joined: bool = False, tile_path: str | None = None) -> DataFrame:
    """Parquet store. ``joined`` reads a header table and its blob table apart
    (linked by id); a header without blob keeps a NULL tile."""
    tiles = spark.read.parquet(path)
    if not joined:
        return tiles
    return tiles.join(spark.read.parquet(tile_path), "id", "left")


def jdbc_tile_reader(
    spark, url: str, table: str, driver: str, lower: int, upper: int, partitions: int, column: str = "x", **options: str
):
    """Reader over a one-table store in a database, split by a numeric column.
    Needs the driver jar on the class path; call ``.load()`` on the result."""
    opts = {
        "url": url, "dbtable": table, "driver": driver, "partitionColumn": column,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions), **options,
    }
    return spark.read.format("jdbc").options(**opts)


def write_tile_store(df: DataFrame, path: str, mode: str = "append", stamp: bool = False) -> None:
    """Append tiles, one folder per zoom, rows near each other in the same file.
    ``stamp`` sets the cache time to now."""
    out = df.withColumn("cached_at", F.current_timestamp()) if stamp else df
    sorted_rows = out.repartitionByRange("zoom", "x", "y").sortWithinPartitions("zoom", "x", "y")
    sorted_rows.write.mode(mode).partitionBy("zoom").parquet(path)


def write_joined_store(df: DataFrame, path: str, tile_path: str, tile: str = "tile", mode: str = "append") -> None:
    """Append tiles in two tables linked by id: headers, one folder per zoom, and the blobs
    apart, so key lookups, counts and expiry never read a tile. Rows without a tile have a header only."""
    write_tile_store(df.drop(tile), path, mode)
    blobs = df.select("id", tile).filter(F.col(tile).isNotNull())
    blobs.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(tile_path)


def read_mbtiles(tiles: DataFrame, zoom: str = "zoom_level", column: str = "tile_column", row: str = "tile_row") -> DataFrame:
    """Tile pyramid rows with row numbers counted from the top."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(zoom).cast("int"))
    return tiles.select(
        F.col(zoom).cast("int").alias("zoom"), F.col(column).cast("bigint").alias("x"),
        (size - 1 - F.col(row)).alias("y"), *[c for c in tiles.columns if c not in (zoom, column, row)],
    )


MBTILES_NAMES = ("name", "format", "bounds", "center", "minzoom", "maxzoom", "attribution", "description", "type", "version")


def mbtiles_metadata(pairs: DataFrame, names: Sequence[str] = MBTILES_NAMES, by: Sequence[str] = ()) -> DataFrame:
    """Name/value pairs to one row; only the listed names become columns."""
    return pairs.groupBy(*by).pivot("name", list(names)).agg(F.first("value"))
