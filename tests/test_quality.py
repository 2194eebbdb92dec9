"""Boundary quality on hand-made squares (zone 37, band U)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from geoloom import rules
from geoloom.functions import rings as G
from geoloom.operators import quality as Q
from geoloom.operators.utm import from_utm

SQUARE = [(400000.0, 5500000.0), (401000.0, 5500000.0), (401000.0, 5501000.0), (400000.0, 5501000.0)]
NOW = dt.datetime(2024, 1, 1)
POLY = (
    "poly_id bigint, place_id bigint, provider string, external_id string, priority int, utm_zone int, "
    "outer array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, explicit_link boolean, updated_at timestamp"
)
PLACE = "place_id bigint, name string, place string, osm_type string, osm_id bigint, x double, y double, utm_zone int, utm_band string"
CENTER = "place_id bigint, seq bigint, provider string, external_id string, priority int, updated_at timestamp, x double, y double, utm_zone int, utm_band string"
REFS = "place_id bigint, seq int, provider string, external_id string, feature_type string"


def ring(points):
    return [{"x": x, "y": y} for x, y in points]


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


HOLE = square(400400.0, 5500400.0, 200.0)
BOW = [SQUARE[0], SQUARE[2], (401000.0, 5500100.0), SQUARE[3]]
MIDDLE = (400500.0, 5500500.0)

# name: polygons (place, outer, holes, link), places (id, name, x, y), centers (place, id, x, y, priority)
CASES = {
    "inside": ([(1, SQUARE, [], False)], [(1, "A", *MIDDLE)], []),
    "outside": ([(1, SQUARE, [], False)], [(1, "A", 405000.0, 5505000.0)], []),
    "near_link": ([(1, SQUARE, [], True)], [(1, "A", 401200.0, 5500500.0)], []),
    "far_link": ([(1, SQUARE, [], True)], [(1, "A", 401600.0, 5500500.0)], []),
    "node": ([], [(1, "A", 400250.0, 5500000.0)], [(1, "77", 400250.0, 5500000.0, 115), (1, "own", 400000.0, 5500000.0, 115)]),
    "alternate": (
        [(1, SQUARE, [], False)], [(1, "A", 405000.0, 5505000.0)],
        [(1, "a", 405000.0, 5505000.0, 120), (1, "b", 400500.0, 5500500.0, 115)],
    ),
    "oversized": ([(1, square(400000.0, 5500000.0, 21000.0), [], False)], [(1, "A", *MIDDLE)], []),
    "two_others": (
        [(1, square(400000.0, 5500000.0, 3000.0), [], False)],
        [(1, "A", *MIDDLE), (2, "B", 401500.0, 5501500.0), (3, "C", 402500.0, 5502500.0)], [],
    ),
    "copies": (
        [(1, square(400000.0, 5500000.0, 3000.0), [], False)],
        [(1, "A", *MIDDLE), (2, "B", 401500.0, 5501500.0), (3, "b", 401550.0, 5501500.0)], [],
    ),
    "hole": ([(1, SQUARE, [HOLE], False)], [(1, "A", 400100.0, 5500100.0), (2, "B", *MIDDLE)], []),
    "bow": ([(1, BOW, [], False)], [(1, "A", *MIDDLE)], []),
    "bad_hole": ([(1, SQUARE, [None], False)], [(1, "A", *MIDDLE)], []),
}


@pytest.fixture(scope="module")
def results(spark):
    """All cases in one run, 60 km apart: (chosen points, center scores, groups)."""
    polys, places, centers = [], [], []
    for i, (ps, pls, cs) in enumerate(CASES.values()):
        base, dy = i * 10, i * 60000.0
        up = lambda pts: None if pts is None else ring([(x, y + dy) for x, y in pts])  # noqa: B023, E731
        for pid, outer, holes, link in ps:
            polys.append((base + pid, base + pid, rules.OSM, "1", 115, 37, up(outer), [up(h) for h in holes], link, NOW))
        places += [(base + pid, n, "village", "node", base + pid, x, y + dy, 37, "U") for pid, n, x, y in pls]
        centers += [
            (base + pid, n, rules.OSM, str(base + pid) if ext == "own" else ext, pr, NOW, x, y + dy, 37, "U")
            for n, (pid, ext, x, y, pr) in enumerate(cs)
        ]
    pl = from_utm(spark.createDataFrame(places, PLACE)).drop("utm_band")
    c = from_utm(spark.createDataFrame(centers, CENTER)).drop("utm_band")
    chosen, scored, groups = Q.rescore(pl, c, spark.createDataFrame(polys, POLY), spark.createDataFrame([], REFS))
    at = {name: i * 10 + 1 for i, name in enumerate(CASES)}
    points = {r.place_id: r for r in chosen.collect()}
    scores = scored.collect()
    rows = {r.place_id: r for r in groups.collect()}
    return {n: (points[k], {r.external_id: r.score for r in scores if r.place_id == k}, rows.get(k)) for n, k in at.items()}


def test_own_center_inside(results):
    g = results["inside"][2]
    assert g.contains_center and not g.rejected_by_geometry
    assert g.center_distance == 0
    assert g.score == 115 + 35 + 4 + 10 + 5


def test_own_center_outside(results):
    g = results["outside"][2]
    assert g.rejected_by_geometry and g.rejection_reason == rules.REASONS["no_center"]


def test_linked_center(results):
    near, far = results["near_link"][2], results["far_link"][2]
    assert near.accepted_by_link and not near.rejected_by_geometry and 199 <= near.center_distance <= 201
    assert not far.accepted_by_link and far.rejected_by_geometry


def test_place_node_preferred(results):
    point, scores, _ = results["node"]
    assert point.x == 400000.0
    assert sorted(scores.values()) == [123, 143]


def test_alternate_center(results):
    g = results["alternate"][2]
    assert g.contains_center and not g.rejected_by_geometry


def test_oversized(results):
    g = results["oversized"][2]
    assert g.rejected_by_geometry and g.rejection_reason == rules.REASONS["large"] % ("441", "250")


def test_two_others_inside(results):
    g = results["two_others"][2]
    assert g.others == 2 and g.rejected_by_containment
    assert g.rejection_reason == rules.REASONS["others"] % 2


def test_near_copies_of_a_place_count_once(results):
    g = results["copies"][2]
    assert g.others == 1 and not g.rejected_by_containment


def test_other_in_hole(results):
    g = results["hole"][2]
    assert g.others == 0 and not g.rejected_by_geometry


def test_self_crossing(results):
    g = results["bow"][2]
    assert g.rejected_by_geometry and g.rejection_reason == rules.REASONS["outer_cross"]


def test_malformed_hole(results):
    g = results["bad_hole"][2]
    assert g.rejected_by_geometry and g.rejection_reason == rules.REASONS["broken"]


def test_drop_chain_of_close_centers(spark):
    rows = [(1, i, 400000.0 + 0.6 * i, 5500000.0, 37, "U") for i in range(6)]
    c = from_utm(spark.createDataFrame(rows, "place_id bigint, seq bigint, x double, y double, utm_zone int, utm_band string"))
    none = c.filter("place_id < 0").drop("seq")
    kept = sorted(r.seq for r in Q.known_centers(none, c).collect())
    assert kept == [0, 2, 4]


def test_crossings_match_brute_force(spark):
    import random

    rnd = random.Random(5)
    shapes = [(i, [(rnd.uniform(0, 100), rnd.uniform(0, 100)) for _ in range(rnd.randint(4, 9))]) for i in range(60)]

    def cross(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def meets(p):
        n = len(p)
        for i in range(n):
            for j in range(i + 2, n):
                if j - i == n - 1:
                    continue
                a, b, c, d = p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]
                if cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0:
                    return True
        return False

    df = spark.createDataFrame([(i, 0, ring(p)) for i, p in shapes], f"poly_id bigint, ring_no int, ring {G.RING}")
    got = {r.poly_id for r in Q.edge_crossings(df).filter(F.col("r1") == F.col("r2")).collect()}
    assert got == {i for i, p in shapes if meets(p)}


def test_scores_and_rejections_make_no_pairs(spark, monkeypatch):
    """Others in a polygon are counted and small rings compared without rows for pairs; the rejections stay."""
    polys = [(i, i, "OSM", str(i), 115, 37, ring(square(400000.0 + 300 * i, 5500000.0, 3000.0)), [], False, NOW) for i in range(30)]
    places = [(i, f"N{i}", "town", "node", i + 1, 401000.0 + 300 * i, 5501000.0, 37, "U") for i in range(30)]
    p = from_utm(spark.createDataFrame(places, PLACE))
    no = p.filter("place_id < 0")
    none = no.selectExpr("place_id", "0L AS seq", "x", "y", "utm_zone", "lat", "lng")
    inst = p.selectExpr("place_id", "place_id AS group_id")
    paired = []
    pairs = Q.pairs_in_polygons
    monkeypatch.setattr(Q, "pairs_in_polygons", lambda a, b, *rest: paired.append(a.count()) or pairs(a, b, *rest))
    monkeypatch.setattr(Q, "_crossings_on_grid", None)
    got = {r.place_id: (r.others, r.rejected_by_containment) for r in Q.reject_polygons(Q.score_polygons(spark.createDataFrame(polys, POLY), p, none, no, inst)).collect()}
    # centers stand 1000 m in, 300 m apart, in squares of 3000 m
    want = {i: sum(1 for k in range(30) if k != i and 0 <= 1000 + 300 * (k - i) < 3000) for i in range(30)}
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, n in want.items() if n >= rules.OTHERS_TO_REJECT}
    assert all(gone for _, gone in got.values()) and not any(paired)
