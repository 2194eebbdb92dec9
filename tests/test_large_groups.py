"""Steps whose tables must grow with the rows, not with the pairs or with wrong guesses of size."""

import math

from pyspark.sql import functions as F

from geoloom.operators import matching as M
from geoloom.operators import quality as Q
from geoloom.session import tune

POINT = "x double, y double, utm_zone int, lat double, lng double"


def at(x, y):
    return (500000.0 + x, 5500000.0 + y, 32, 49.65 + y / 111200, 9.0 + x / 72200)


def test_small_files_that_grow_are_not_broadcast(spark, tmp_path):
    """A key of a few bytes that becomes many rows: its file says little of its size."""
    spark.range(300_000).write.parquet(str(tmp_path / "keys"))
    keys = tune(spark).read.parquet(str(tmp_path / "keys"))
    grown = keys.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50))))
    plan = grown.join(grown.withColumnRenamed("i", "j"), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def agreement(rows):
    out = []
    for place, seq, x, y, *_ in rows:
        d = [math.hypot(x - r[2], y - r[3]) for r in rows if r[0] == place]
        out.append((place, seq, 8 * (sum(m <= 3000 for m in d) - 1) - 12 * sum(m > 25000 for m in d)))
    return sorted(out)


def test_center_agreement_few_and_many_spots(spark, monkeypatch):
    rows = [(1, i, *at(i * 2500.0, 0.0)) for i in range(12)] + [(1, 90, *at(0.0, 0.0))]
    rows += [(2, i, *at(i % 20 * 1700.0, i // 20 * 1300.0)) for i in range(60)]
    centers = spark.createDataFrame(rows, "place_id int, seq int, " + POINT)
    monkeypatch.setattr(Q, "FEW_SPOTS", 20, raising=False)
    assert sorted(tuple(r) for r in Q.center_agreement(centers).collect()) == agreement(rows)
    # few spots are not repeated over a grid
    monkeypatch.setattr(Q, "near_pairs", None)
    first = centers.filter("place_id = 1")
    assert sorted(tuple(r) for r in Q.center_agreement(first).collect()) == agreement(rows[:13])


def test_pairs_of_namesakes_are_never_kept(spark, monkeypatch):
    cols = "place_id int, name string, place string, region string, district string, osm_type string, osm_id int, " + POINT
    held = [(i, "ab", ("town", "village")[i % 2], "", "", "node", 0, *at(i % 8 * 900.0, i // 8 * 900.0)) for i in range(40)]
    held += [(100, "ab", "town", "", "", "node", 0, *at(0.0, 0.0)), (101, "cd", "city", "", "", "node", 0, *at(1000.0, 0.0)), (102, "cd", "hamlet", "", "", "node", 0, *at(1700.0, 0.0))]
    new = [(i, "AB", ("town", "hamlet")[i % 2], "", "", "node", 0, *at(i * 150.0, i * 90.0)) for i in range(40)]
    new += [(50, "cd", "", "", "", "node", 0, *at(1000.0, 10.0)), (51, "cd", "town", "", "", "node", 0, *at(1340.0, 0.0)), (52, "cd", "town", "", "", "node", 0, *at(300.0, 0.0)), (0, *new[0][1:])]
    kept = []

    def recorded(df):
        kept.append(df.count())
        return df

    monkeypatch.setattr(M, "cut_lineage", recorded)
    h, n = spark.createDataFrame(held, cols), spark.createDataFrame(new, cols)
    got = M.match_nearest_unambiguous(n, M.place_names(n), h, M.place_names(h))
    limit = {"city": 8000, "town": 5000, "village": 2500, "hamlet": 1500}
    wanted = []
    for i, name, place, *_, x, y, _, _, _ in dict.fromkeys(new):
        pool = [(math.hypot(x - r[7], y - r[8]), r[0], r[2]) for r in held if r[1] == name.lower()]
        if any(c == place for _, _, c in pool):
            pool = [p for p in pool if p[2] == place]
        pool.sort()
        if pool[0][0] <= limit.get(place, 800) and (len(pool) == 1 or pool[0][0] <= 250 or pool[1][0] - pool[0][0] >= 500):
            wanted.append((i, pool[0][1]))
    assert sorted({(r["incoming_id"], r["place_id"]) for r in got.collect()}) == sorted(wanted)
    assert max(kept) <= 50
