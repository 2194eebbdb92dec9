"""Merging of small snapshots."""

import datetime as dt

from geoloom import rules
from geoloom.operators import merging as M
from geoloom.operators.utm import from_utm

NOW, OLD = dt.datetime(2024, 2, 1), dt.datetime(2023, 2, 1)
TEXT = ", ".join(f"{c} string" for c in M.TEXTS)


def snap(spark, places, refs=(), polygons=()):
    """places: (id, name, region, x or None); polygons: (place, provider, ext, ring)."""
    p = spark.createDataFrame(
        [(i, n, "village", "", "", "", r, "", "", 0, x, None if x is None else 5500000.0, None if x is None else 37, "U") for i, n, r, x in places],
        f"place_id bigint, {TEXT}, osm_type string, osm_id bigint, x double, y double, utm_zone int, utm_band string",
    )
    p = from_utm(p).drop("utm_band")
    aliases = spark.createDataFrame([], "place_id bigint, seq int, alias string")
    r = spark.createDataFrame([(i, 0, pr, e, "node") for i, pr, e in refs], "place_id bigint, seq int, provider string, external_id string, feature_type string")
    c = spark.createDataFrame([], "place_id bigint, provider string, external_id string, priority int, score int, updated_at timestamp_ntz, x double, y double, utm_zone int, lat double, lng double")
    g = spark.createDataFrame(
        [(i, pr, e, 100, 7, NOW, ring, None, 37, "", "", link) for i, pr, e, ring, link in polygons],
        "place_id bigint, provider string, external_id string, priority int, score int, updated_at timestamp_ntz, ring_text string, holes_text string, utm_zone int, boundary string, admin_level string, explicit_link boolean",
    )
    return M.Snapshot(p, aliases, r, c, g)


def test_namesakes_stay_apart(spark):
    held = snap(spark, [(1, "Kovalivka", "", 400000.0), (2, "Kovalivka", "", 404000.0)])
    new = snap(spark, [(1, "kovalivka", "", 404050.0)], refs=[(1, "Geo", "x9")])
    m = M.merge_snapshots(held, new)
    assert m.places.count() == 2
    assert [r.place_id for r in m.refs.collect()] == [2]


def test_no_evidence_no_merge(spark):
    held = snap(spark, [(1, "Kovalivka", "", None)])
    new = snap(spark, [(1, "Kovalivka", "", None)])
    assert M.merge_snapshots(held, new).places.count() == 2


def test_context_is_enough_without_points(spark):
    held = snap(spark, [(1, "Kovalivka", "North", None)])
    new = snap(spark, [(1, "Kovalivka", "north", None)])
    assert M.merge_snapshots(held, new).places.count() == 1


def test_provider_replacement(spark):
    held = snap(
        spark, [(1, "A", "", 400000.0)], refs=[(1, "Geo", "1")],
        polygons=[(1, "Geo", "1", "old", True), (1, "Azure", "2", "other", False)],
    )
    new = snap(spark, [(5, "A", "", 400010.0)], refs=[(5, "geo", "1")], polygons=[(5, "Geo", "1", "new", False)])
    got = {(r.provider, r.ring_text) for r in M.merge_replacing(held, new, ["GEO"]).polygons.collect()}
    assert got == {("Geo", "new"), ("Azure", "other")}
    kept = {(r.provider, r.ring_text) for r in M.merge_snapshots(held, new).polygons.collect()}
    assert kept == {("Geo", "old"), ("Geo", "new"), ("Azure", "other")}


def test_merge_is_idempotent(spark):
    held = snap(spark, [(1, "A", "r", 400000.0)], refs=[(1, "Geo", "1")], polygons=[(1, "Geo", "1", "ring", True)])
    once = M.merge_snapshots(held, held)
    twice = M.merge_snapshots(once, held)
    for name in ("places", "refs", "polygons"):
        a, b = getattr(once, name), getattr(twice, name)
        cols = [c for c in a.columns if c != "score"]
        assert sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))


def test_new_rows_with_one_reference_are_one_place(spark):
    held = snap(spark, [(1, "A", "", 400000.0)])
    new = snap(spark, [(1, "B", "", 500000.0), (2, "C", "", 510000.0)], refs=[(1, "Geo", "7"), (2, "geo", "7")])
    m = M.merge_snapshots(held, new)
    assert sorted(r.place_id for r in m.places.collect()) == [-2, 1]
    assert {r.alias for r in m.aliases.collect()} >= {"B", "C"}
    assert rules.LEGACY == "Legacy cache"
