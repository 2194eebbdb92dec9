"""Versioned place snapshots: tables in a version folder, a manifest of its files, and one pointer file.

A version becomes current by one atomic rename of the pointer; the version before it stays
as the backup. The manifest holds name, size and SHA-256 of each data file, so a damaged
file is named from a listing, without reading any data.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.operators.merging import TEXTS, Snapshot

SCHEMA_VERSION = 3
POINTER = "current.json"


class NewerSnapshotError(ValueError):
    """The snapshot was written by a later format than this code knows."""


class DamagedSnapshotError(OSError):
    """Neither the current version nor the backup is whole."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, hadoop


def _write_pointer(spark: SparkSession, root: str, state: dict) -> None:
    """Write beside, then rename over: readers see the old or the new pointer."""
    fs, _, hadoop = _fs(spark, root)
    fresh, final = hadoop.Path(f"{root}/{POINTER}.new"), hadoop.Path(f"{root}/{POINTER}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext
    conf = spark._jsc.hadoopConfiguration()
    context = files.getFileContext(final.toUri(), conf) if final.toUri().getScheme() else files.getFileContext(conf)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(fresh, final, options)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _read_pointer(spark: SparkSession, root: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{root}/{POINTER}").collect()))


def pointer(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says; None where nothing was ever written. Newer formats are refused."""
    try:
        state = _read_pointer(spark, root)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return None
    if state.get("schema_version", 0) > SCHEMA_VERSION:
        raise NewerSnapshotError(f"snapshot format {state['schema_version']} is newer than {SCHEMA_VERSION}")
    return state


def _listed(spark: SparkSession, folder: str, deep: bool) -> DataFrame:
    """``(file, bytes, sha256)`` of the data files below a version folder; contents are read for checksums only."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    digest = F.sha2("content", 256) if deep else F.lit(None).cast("string")
    return found.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), digest.alias("sha256"))


def write_tables(tables: Mapping[str, DataFrame], root: str, version: str | None = None, **notes) -> str:
    """Write a version of all tables with its manifest, then point to it.

    A failure at any moment leaves the current version as it was. A version of a given name is written anew,
    so an interrupted attempt can be repeated; the name of the current or backup version is refused.
    ``notes`` are kept in the pointer and change with it. Rows are laid out by zone and
    position where there are such columns, else by place, so area reads skip files.
    """
    spark = next(iter(tables.values())).sparkSession
    state = pointer(spark, root) or {}
    held = (state.get("current"), state.get("backup"))
    if version is not None and version in held:
        raise ValueError(f"version {version} is in use")
    name = version or datetime.now(timezone.utc).strftime("v%Y%m%dT%H%M%S%f")
    folder = f"{root}/{name}"
    for table, df in tables.items():
        sort = [c for c in ("utm_zone", "lat", "lng", "place_id") if c in df.columns]
        laid = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
        laid.write.mode("errorifexists" if version is None else "overwrite").parquet(f"{folder}/{table}")
    _listed(spark, folder, deep=True).write.mode("overwrite").json(f"{folder}/manifest")
    schemas = {v: s for v, s in state.get("schemas", {}).items() if v == state.get("current")}
    schemas[name] = {table: df.schema.json() for table, df in tables.items()}
    kept = {k: v for k, v in state.items() if k not in ("current", "backup", "schema_version", "schemas")}
    _write_pointer(spark, root, {**kept, **notes, "current": name, "backup": state.get("current"), "schema_version": SCHEMA_VERSION, "schemas": schemas})
    return name


def damaged_files(spark: SparkSession, root: str, version: str, deep: bool = False) -> DataFrame:
    """``(file, problem)``: what of a version is missing or differs from the manifest.

    Sizes come from a listing. ``deep`` reads all files and compares checksums too. Errors
    other than a missing folder, a lost executor for one, are raised and never taken for damage.
    """
    folder = f"{root}/{version}"
    try:
        manifest = spark.read.schema("file string, bytes long, sha256 string").json(f"{folder}/manifest")
        there = _listed(spark, folder, deep).select("file", F.col("bytes").alias("now"), F.col("sha256").alias("sha256_now"))
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([("manifest", "missing")], "file string, problem string")
    both = manifest.join(there, "file", "left")
    changed = F.col("sha256_now") != F.col("sha256") if deep else F.lit(False)
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("bytes"), "other size").when(changed, "other content")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def read_tables(spark: SparkSession, root: str, deep: bool = False) -> dict[str, DataFrame]:
    """The tables of the current version, or of the backup when files of the current one are damaged."""
    state = pointer(spark, root)
    if state is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    damage = {}
    for version in filter(None, (state["current"], state.get("backup"))):
        damage[version] = [tuple(r) for r in damaged_files(spark, root, version, deep).orderBy("file").limit(20).collect()]
        if not damage[version]:
            schemas = state["schemas"][version]
            return {t: spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f"{root}/{version}/{t}") for t, s in schemas.items()}
    raise DamagedSnapshotError(f"no whole version under {root}: {damage}")


def write_snapshot(snapshot: Snapshot | DataFrame, root: str, version: str | None = None, **notes) -> str:
    """Store all five tables of a snapshot, or a table of places alone, as one version."""
    tables = {"places": snapshot} if isinstance(snapshot, DataFrame) else vars(snapshot)
    return write_tables(tables, root, version, **notes)


def read_snapshot(spark: SparkSession, root: str, deep: bool = False) -> Snapshot | DataFrame:
    """What :func:`write_snapshot` stored: the current version, or the backup when it is damaged."""
    tables = read_tables(spark, root, deep)
    return tables["places"] if set(tables) == {"places"} else Snapshot(**tables)


POINT = "x double, y double, utm_zone int, lat double, lng double"
#: A place with all that belongs to it, as loaders publish it.
DOCUMENT = (
    "place_id bigint, " + ", ".join(f"{c} string" for c in TEXTS) + f", osm_type string, osm_id bigint, {POINT}, "
    "aliases array<struct<seq:int,alias:string>>, "
    "refs array<struct<seq:int,provider:string,external_id:string,feature_type:string>>, "
    "centers array<struct<provider:string,external_id:string,priority:int,score:int,updated_at:timestamp_ntz,x:double,y:double,utm_zone:int,lat:double,lng:double>>, "
    "polygons array<struct<provider:string,external_id:string,priority:int,score:int,updated_at:timestamp_ntz,ring_text:string,holes_text:string,"
    "utm_zone:int,boundary:string,admin_level:string,explicit_link:boolean>>"
)


def from_documents(docs: DataFrame) -> Snapshot:
    """The five tables of nested place documents (:data:`DOCUMENT`)."""
    inner = {t: docs.select("place_id", F.inline(t)) for t in ("aliases", "refs", "centers", "polygons")}
    return Snapshot(docs.drop(*inner), **inner)


def snapshot_to_json(places: DataFrame, path: str) -> None:
    places.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").json(path)


def snapshot_from_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines of places; rows of newer formats are refused."""
    df = spark.read.schema(schema).json(path)
    return df.filter(
        F.when(F.coalesce(F.col("schema_version"), F.lit(0)) > SCHEMA_VERSION, F.raise_error(F.lit("snapshot format is newer"))).otherwise(True)
    ).drop("schema_version")
