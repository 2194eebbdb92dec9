"""Readers and writers on hand-made documents and folders."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.catalog import QUERIES
from geoloom.functions import rings as G
from geoloom.operators import tile_store as T
from geoloom.operators.tiling import plan_tiles
from geoloom.session import work_folder
from geoloom.sources import geojson, gpx, osm, responses, snapshot
from geoloom.sources.json_members import read_members


def geo(spark, doc):
    df = spark.createDataFrame([(1, json.dumps(doc))], "id bigint, body string")
    return geojson.project_rings(geojson.read_geojson(df, "id").withColumn("n", F.monotonically_increasing_id()), ["id", "n"]).collect()


def box(x, y, s):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def test_geojson_hole(spark):
    rows = geo(spark, {"type": "Polygon", "coordinates": [box(36.0, 49.0, 0.02), box(36.005, 49.005, 0.01)]})
    assert len(rows) == 1 and len(rows[0].holes) == 1 and rows[0].utm_zone == 37


def test_geojson_multi(spark):
    rows = geo(spark, {"type": "MultiPolygon", "coordinates": [[box(36.0, 49.0, 0.01)], [box(36.02, 49.0, 0.01)]]})
    assert len(rows) == 2 and all(len(r.outer) == 4 for r in rows)


# a field of 0.04 x 0.02 degrees with a pond in it, as two relation members
CORNERS = {811: (61.50, 23.70), 812: (61.50, 23.74), 813: (61.52, 23.74), 814: (61.52, 23.70)}
POND = {821: (61.505, 23.71), 822: (61.505, 23.72), 823: (61.51, 23.72)}


def osm_doc(ways, members):
    return {
        "elements": [
            *({"type": "relation", "id": 7004, "members": [{"type": t, "ref": r, "role": role} for t, r, role in members]},),
            *({"type": "way", "id": i, "nodes": nodes} for i, nodes in ways.items()),
            *({"type": "node", "id": i, "lat": at[0], "lon": at[1]} for i, at in (CORNERS | POND).items()),
        ]
    }


OSM = osm_doc(
    {31: [814, 813, 812, 811, 814], 32: [821, 822, 823, 821]},
    [("node", 900, "label"), ("way", 32, "inner"), ("way", 31, "outer")],
)


def rings_of(spark, doc):
    e = osm.read_osm_elements(spark.createDataFrame([(json.dumps(doc),)], "body string"))
    rel = e.filter("type = 'relation'").withColumnRenamed("id", "relation_id")
    v = osm.assemble_ways(rel, e.filter("type = 'way'"), e.filter("type = 'node'"))
    return osm.assemble_rings(v.withColumnsRenamed({"lng": "x", "lat": "y"}))


def test_osm_relation(spark):
    shapes = geojson.project_rings(osm.holes_to_outer(rings_of(spark, OSM)), ["relation_id", "outer_no"]).collect()
    assert len(shapes) == 1 and shapes[0].utm_zone == 34
    assert len(shapes[0].outer) == 4 and [len(h) for h in shapes[0].holes] == [3]


def test_osm_chain_in_any_direction(spark):
    ways = {41: [812, 811], 42: [812, 813], 43: [811, 814], 44: [814, 813], 45: [811, 813]}
    whole = [("way", i, "outer") for i in (44, 41, 42, 43)]
    rows = rings_of(spark, osm_doc(ways, whole)).select(G.ring_area("ring").alias("a"), F.size("ring").alias("n")).collect()
    assert len(rows) == 1 and rows[0].n == 4 and abs(rows[0].a - 8e-4) < 1e-9
    assert rings_of(spark, osm_doc(ways, whole[1:])).count() == 0


def test_label_nodes(spark):
    doc = osm_doc({}, [("node", 61, "stop"), ("node", 62, "admin_centre"), ("way", 31, "label"), ("node", 63, "label"), ("node", 64, "")])
    e = osm.read_osm_elements(spark.createDataFrame([(json.dumps(doc),)], "body string"))
    relations = e.filter("type = 'relation'").withColumnRenamed("id", "relation_id")
    assert {r.node_id for r in osm.relation_label_nodes(relations).collect()} == {62, 63}


PLAN = "center_x bigint, center_y bigint, view_w bigint, view_h bigint, min_x bigint, min_y bigint, max_x bigint, max_y bigint, scale double, margin int"


@pytest.mark.parametrize(
    "row, count, held",
    [
        ((50, 50, 3, 2, 0, 0, 100, 100, 1.0, 1), 63, {(50, 50)}),
        ((0, 0, 1, 1, 0, 0, 100, 100, 1.0, 1), 9, {(0, 0), (2, 2)}),
        ((20, 20, 3, 2, 0, 0, 100, 100, 0.5, 1), 35, {(17, 18), (23, 22)}),
    ],
)
def test_plan_tiles(spark, row, count, held):
    t = plan_tiles(spark.createDataFrame([row], PLAN)).orderBy("dist_sqr", "tile_x", "tile_y").collect()
    cells = {(r.tile_x, r.tile_y) for r in t}
    assert len(t) == len(cells) == count and held <= cells
    assert (t[0].tile_x, t[0].tile_y) == (row[0], row[1])


def test_snapshot_round_trip_and_backup(spark):
    root = work_folder(spark, "snapshot")
    rows = spark.createDataFrame([(1, "A", [("Geo", "1")])], "place_id bigint, name string, refs array<struct<provider:string,external_id:string>>")
    first = snapshot.write_snapshot(rows, root)
    assert snapshot.read_snapshot(spark, root).collect() == rows.collect()
    second = snapshot.write_snapshot(rows.withColumn("name", F.lit("B")), root)
    assert first != second and snapshot.read_snapshot(spark, root).first().name == "B"
    # the current version is damaged: the backup is read
    state = snapshot._read_pointer(spark, root)
    snapshot._write_pointer(spark, root, {**state, "current": "gone"})
    assert snapshot.read_snapshot(spark, root).first().name == "A"
    snapshot._write_pointer(spark, root, {**state, "schema_version": 4})
    with pytest.raises(snapshot.NewerSnapshotError):
        snapshot.read_snapshot(spark, root)


def test_damaged_snapshots_are_named(spark):
    root = work_folder(spark, "snapshot")
    with pytest.raises(FileNotFoundError):
        snapshot.read_tables(spark, root)
    one = {"places": spark.range(50).withColumnRenamed("id", "place_id"), "refs": spark.range(9).withColumnRenamed("id", "place_id")}
    two = {"places": spark.range(70).withColumnRenamed("id", "place_id"), "refs": spark.range(0).withColumnRenamed("id", "place_id")}
    first = snapshot.write_tables(one, root, note="a")
    second = snapshot.write_tables(two, root, version="named")
    with pytest.raises(ValueError):
        snapshot.write_tables(two, root, version="named")
    state = snapshot.pointer(spark, root)
    assert (state["current"], state["backup"], state["note"]) == (second, first, "a")

    def count(deep=False):
        return {t: df.count() for t, df in snapshot.read_tables(spark, root, deep).items()}

    assert count() == count(True) == {"places": 70, "refs": 0}
    file = spark.read.json(f"{root}/named/manifest").filter("file LIKE 'places%'").first()
    fs, path, hadoop = snapshot._fs(spark, f"{root}/named/{file.file}")

    def rewrite(size):
        out = fs.create(path, True)
        out.write(bytearray(size))
        out.close()

    def problems(deep):
        return [tuple(r) for r in snapshot.damaged_files(spark, root, "named", deep).collect()]

    rewrite(file.bytes)  # the same size: seen by checksums only
    assert problems(False) == [] and problems(True) == [(file.file, "other content")] and count(True) == {"places": 50, "refs": 9}
    rewrite(5)
    assert problems(False) == [(file.file, "other size")] and count() == {"places": 50, "refs": 9}
    fs.delete(path, False)
    assert problems(False) == [(file.file, "missing")] and count() == {"places": 50, "refs": 9}
    fs.delete(hadoop.Path(f"{root}/{first}"), True)
    with pytest.raises(snapshot.DamagedSnapshotError, match="manifest"):
        snapshot.read_tables(spark, root)


def test_other_errors_are_not_taken_for_damage(spark, monkeypatch):
    root = work_folder(spark, "snapshot")
    for n in (3, 4):
        snapshot.write_tables({"places": spark.range(n)}, root)

    def lost(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(snapshot, "_listed", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        snapshot.read_tables(spark, root)


def test_snapshot_json(spark):
    root = work_folder(spark, "json")
    rows = spark.createDataFrame([(1, "A")], "place_id bigint, name string")
    snapshot.snapshot_to_json(rows, root)
    back = snapshot.snapshot_from_json(spark, root, "place_id bigint, name string, schema_version int")
    assert back.collect() == rows.collect()


def test_gpx_files(spark, small):
    path = work_folder(spark, "gpx")
    fixes = P.event_points(spark, small)
    gpx.write_gpx(fixes, path, "user_id", tie=("event_id",))
    back = gpx.read_gpx(spark, path)
    assert back.count() == fixes.count()
    a = fixes.select(F.col("user_id").cast("string"), F.round("lat", 4), F.round("lng", 4), F.col("ts").cast("timestamp")).collect()
    b = back.select("name", F.round(F.col("lat").cast("double"), 4), F.round(F.col("lng").cast("double"), 4), "ts").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_tile_store_files(spark, small):
    from geoloom.catalog.stores import store

    path, target = work_folder(spark, "tiles"), work_folder(spark, "kept")
    s = store(spark, small)
    T.write_tile_store(s, path, stamp=False)
    assert T.read_tile_store(spark, path).count() == s.count()
    day = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    T.rewrite_without_expired(spark, path, target, day, 1)
    assert T.read_tile_store(spark, target).count() == T.expire_rows(s, day, 1).count()


def _awkward(n):
    """Elements with braces, quotes, backslashes and brackets in texts, deep and empty objects."""
    rows = []
    for i in range(n):
        e = {"type": ("node", "way", "relation")[i % 3], "id": i, "tags": {"name": ['a } b', 'q" : [{', "\\", '\\"elements":[{', "Київ {", "]"][i % 6] * (i % 5)}}
        if i % 4 == 0:
            e["members"] = [{"type": "way", "ref": i * 10 + j, "role": '"elements": [{' if j % 2 else ""} for j in range(i % 7)]
        if i % 5 == 0:
            e["center"] = {"lat": i / 10, "lon": -i / 10}
        rows.append(e)
    return rows


@pytest.mark.parametrize("block", [64, 301, 4096])
def test_members_by_byte_ranges(spark, tmp_path, block):
    """Every element of files cut at any place, as a JSON parser finds them."""
    head = {"version": 0.6, "osm3s": {"x": {"elements": [{"type": "no", "id": -1}]}, "y": {"z": {}}, "w": {}}, "other": [{"id": -2}, {"id": -3}]}
    docs = {
        "plain.json": [({"elements": _awkward(60)}, None)],
        "pretty.json": [({**head, "elements": _awkward(40), "after": [{"id": -4}, 5], "last": {"a": {"b": 1}}}, 2)],
        "lines.json": [({"elements": _awkward(k)}, None) for k in (0, 1, 7, 2)],
        "empty.json": [({"elements": []}, None)],
    }
    for name, parts in docs.items():
        (tmp_path / name).write_text("\n".join(json.dumps(d, indent=i, ensure_ascii=name == "plain.json") for d, i in parts), encoding="utf-8")
    (tmp_path / "nothing.json").write_text("")
    (tmp_path / "cut.json").write_text('{"elements":[null, 3, {"id": 900001}, {"id": 900002, "tags": {"na')
    want = sorted(json.dumps(e, sort_keys=True) for parts in docs.values() for d, _ in parts for e in d["elements"])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_members(spark, str(tmp_path), "elements").select("value").collect()
        n = osm.read_osm_files(spark, str(tmp_path)).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = [json.loads(r.value) for r in got]
    assert sorted(json.dumps(e, sort_keys=True) for e in got if e["id"] != 900001) == want
    assert n == len(want) + 1


def test_geojson_files(spark, tmp_path):
    poly = lambda x: {"type": "Polygon", "coordinates": [box(x, 49.0, 0.01)]}
    docs = {
        "many": {"type": "FeatureCollection", "features": [{"type": "Feature", "id": i, "properties": {"t": "}"}, "geometry": poly(30 + i / 10)} for i in range(9)]},
        "coll": {"type": "GeometryCollection", "geometries": [poly(36.0), {"type": "Point", "coordinates": [1, 2]}, poly(37.0)]},
        "one": poly(38.0),
        "feature": {"type": "Feature", "id": 77, "properties": {"t": "a } in a text"}, "geometry": poly(39.0)},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc) + ("\n" if name == "one" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        rows = geojson.read_geojson_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.id or "", round(r.outer[0].x, 3)) for r in rows) == sorted(
        [(str(i), round(30 + i / 10, 3)) for i in range(9)] + [("", 36.0), ("", 37.0), ("", 38.0), ("77", 39.0)]
    )


def test_directions_are_whole(spark, small):
    """Totals, the line of the route, and every step with its line, of both formats."""
    amount, at = {"text": "5 u", "value": 5}, {"lat": 38.5, "lng": -120.2}
    step = {"travel_mode": "DRIVING", "html_instructions": "turn", "duration": amount, "distance": amount, "start_location": at, "end_location": at}
    leg = {"duration": amount, "distance": amount, "start_location": at, "end_location": at, "start_address": "a", "end_address": "b"}
    line = {"points": "_p~iF~ps|U_ulLnnqC_mqNvxq`@"}
    route = {"summary": "s", "copyrights": "c", "overview_polyline": line, "legs": [leg | {"steps": [step | {"polyline": line}, step]}]}
    gpx_body = (
        '<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1.5" lon="2.5"/><wpt lat="3.5" lon="4.5"/>'
        '<rte><rtept lat="1.5" lon="2.5"><desc>go</desc></rtept></rte></gpx>'
    )
    rows = [(1, "google", json.dumps({"status": "OK", "routes": [route]})), (2, "gpx", gpx_body), (3, "google", json.dumps({"status": "NOT_FOUND", "routes": [route]}))]
    h, s = responses.parse_directions(spark.createDataFrame(rows, "id int, format string, body string"), "id")
    spots = lambda ps: ps and [(round(p.lat, 5), round(p.lng, 5)) for p in ps]
    want = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert {r.id: spots(r.route) for r in h.collect()} == {1: want, 2: [(1.5, 2.5), (3.5, 4.5)], 3: None}
    assert sorted((r.id, r.step, spots(r.points)) for r in s.collect()) == [(1, 0, want), (1, 1, None), (2, 0, None)]
    # the query gives all of it: a row for each answer and one for each step
    got = QUERIES["parse_directions"](spark, small)
    assert {"distance", "distance_value", "start_lng", "end_lat", "copyrights", "line", "instructions"} <= set(got.columns)
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    assert got.filter("step IS NULL").count() == lines.select("l_orderkey").distinct().count()
    assert got.filter("step IS NOT NULL").count() == 2 * lines.count()
