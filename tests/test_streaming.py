"""Streams over files that arrive in parts."""

import datetime as dt

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom.operators import routes as R
from geoloom.operators.merging import TEXTS
from geoloom.session import work_folder
from geoloom.sources import snapshot
from geoloom.streaming import jobs


def feed(spark, df, parts=3):
    """Write a table as several files, by its ``__part``, and read it as a stream."""
    root = work_folder(spark, "feed")
    for i in range(parts):
        df.filter(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(df.drop("__part").schema).option("maxFilesPerTrigger", 1).parquet(root)


def run(df, mode="append"):
    spark = df.sparkSession
    out = work_folder(spark, "stream")
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", out + "/state").trigger(availableNow=True).start(out + "/rows")
    q.awaitTermination()
    return spark.read.parquet(out + "/rows")


def parted(df, edges):
    part = F.lit(0)
    for i, e in enumerate(edges):
        part = F.when(F.col("ts") >= e, i + 1).otherwise(part)
    return df.withColumn("__part", part)


def test_track_legs_across_batches(spark, small):
    ev = P.event_points(spark, small).withColumnRenamed("user_id", "session").select("session", "event_id", "ts", "lat", "lng")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    edges = [lo + (hi - lo) * f for f in (0.3, 0.7)]
    legs = run(jobs.stream_track_legs(feed(spark, parted(ev, edges)), lateness="1 day"))
    whole = R.leg_metrics(ev, "session", ["ts", "event_id"])
    a = sorted((r.session, round(r.lat, 6), None if r.leg_km is None else round(r.leg_km, 6)) for r in legs.collect())
    b = sorted((r.session, round(r.lat, 6), None if r.leg_km is None else round(r.leg_km, 6)) for r in whole.collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_legs_come_in_order_however_fixes_arrive(spark):
    day = dt.datetime(2024, 5, 1)
    fixes = [(s, 100 * s + i, day + dt.timedelta(minutes=7 * i + s), 50.0 + i / 100, 30.0 + s) for s in range(3) for i in range(40)]
    fixes += [(0, 999, day + dt.timedelta(minutes=7 * 10), 51.0, 31.0), (1, 998, day + dt.timedelta(days=1), 52.0, 32.0), (2, 997, day + dt.timedelta(days=3), 53.0, 33.0)]
    rows = spark.createDataFrame(fixes, "session bigint, event_id bigint, ts timestamp, lat double, lng double")
    shuffled = F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int")
    late = F.when(F.col("ts") < F.lit(day + dt.timedelta(hours=6)), shuffled).when(F.col("event_id") == 998, 4).otherwise(5)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    jobs.rocksdb_state(spark)
    try:
        got = [
            sorted(map(str, run(jobs.stream_legs_in_order(feed(spark, rows.withColumn("__part", part), 6), "8 hours", 3 * 3_600_000)).collect()))
            for part in (F.lit(0), late)
        ]
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1] and len(got[0]) == len(fixes) - 1  # the last fix is not yet passed
    whole = R.leg_metrics(rows.filter("event_id <> 997"), "session", ["ts", "event_id"])
    want = [(r.session, r.ts, r.lat, r.lng, None if r.event_id == 998 else r.leg_km) for r in whole.collect()]
    assert sorted(x.rsplit(", leg_bearing", 1)[0] for x in got[0]) == sorted(f"Row(session={s}, ts={t!r}, lat={a}, lng={b}, leg_km={k}" for s, t, a, b, k in want)


def test_sessions_in_order_share_their_state(spark):
    day = dt.datetime(2024, 5, 1)
    fixes = [(s or None, 10 * s + i, day + dt.timedelta(minutes=90 * i + s % 7), 50.0 + i / 100, 30.0 + s / 100) for s in range(200) for i in range(6)]
    fixes += [(5, 9999, None, 1.0, 1.0)]
    rows = spark.createDataFrame(fixes, "session bigint, event_id bigint, ts timestamp, lat double, lng double")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    jobs.rocksdb_state(spark)
    try:
        legs = jobs.stream_legs_in_order(feed(spark, rows.withColumn("__part", F.pmod(F.xxhash64("event_id"), F.lit(3)))), "10 hours", 100 * 60_000, parts=3)
        out = work_folder(spark, "stream")
        q = legs.writeStream.format("parquet").option("checkpointLocation", out + "/state").trigger(availableNow=True).start(out + "/rows")
        q.awaitTermination()
        held = [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators]
        assert 0 < max(held) < 50  # chunks of fixes by part, not fixes or sessions
    finally:
        spark.conf.set(key, before)
    end = max(f[2] for f in fixes if f[2]) - dt.timedelta(hours=10)
    got = sorted((-1 if r.session is None else r.session, r.ts, r.leg_km is None) for r in spark.read.parquet(out + "/rows").collect())
    assert got == sorted((-1 if s is None else s, t, t == day + dt.timedelta(minutes=(s or 0) % 7)) for s, _, t, _, _ in fixes if t and t <= end)


def test_hit_counts(spark, small):
    ev = P.event_points(spark, small).select("ts", F.col("event_type").alias("source"))
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    edges = [lo + (hi - lo) * f for f in (0.4, 0.8)]
    got = run(jobs.stream_hit_counts(feed(spark, parted(ev, edges)), window="1 day")).collect()
    want = jobs.stream_hit_counts(ev, window="1 day").collect()
    # the last open window stays in the state
    last = max(r.window_start for r in want)
    assert sorted(map(str, got)) == sorted(str(r) for r in want if r.window_start < last)


def test_snapshot_merge_batches_may_repeat(spark):
    root = work_folder(spark, "held")
    df = spark.range(9).select(F.col("id"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"), (F.col("id") % 3).cast("int").alias("__part"))

    def merge(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    jobs.stream_merge_snapshots(feed(spark, df), merge, work_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == list(range(9))


def documents(spark, rows):
    """rows: (id, name, external id, alias)."""
    texts = ", ".join(f"CAST('{'village' if c == 'place' else ''}' AS string) AS {c}" for c in TEXTS if c != "name")
    df = spark.createDataFrame(rows, "place_id bigint, name string, external_id string, alias string")
    return df.selectExpr(
        "place_id", "name", *texts.split(", "), "'' AS osm_type", "0L AS osm_id", "double(NULL) AS x", "double(NULL) AS y", "int(NULL) AS utm_zone", "double(NULL) AS lat", "double(NULL) AS lng",
        "array(named_struct('seq', 0, 'alias', alias)) AS aliases", "array(named_struct('seq', 0, 'provider', 'Geo', 'external_id', external_id, 'feature_type', 'node')) AS refs",
        "from_json('[]', 'array<struct<provider:string,external_id:string,priority:int,score:int,updated_at:timestamp_ntz,x:double,y:double,utm_zone:int,lat:double,lng:double>>') AS centers",
        "from_json('[]', 'array<struct<provider:string,external_id:string,priority:int,score:int,updated_at:timestamp_ntz,ring_text:string,holes_text:string,utm_zone:int,boundary:string,admin_level:string,explicit_link:boolean>>') AS polygons",
    )


def tables(spark, root):
    s = snapshot.read_snapshot(spark, root, deep=True)
    return {t: sorted(map(str, df.collect())) for t, df in vars(s).items()}


def test_parts_merge_into_the_held_snapshot(spark):
    rows = [(1, "Alpha", "a", "first"), (2, "Beta", "b", "second"), (3, "Alpha", "a", "third"), (4, "Gamma", "c", "fourth"), (5, "Beta", "b", "second")]
    docs = documents(spark, rows)
    found = []
    for part in (F.lit(0), (F.col("place_id") > 3).cast("int"), F.floor(F.col("place_id") / 2).cast("int")):
        root, state = work_folder(spark, "held"), work_folder(spark, "state")
        source = feed(spark, docs.withColumn("__part", part))
        for _ in range(2):  # started again: nothing new
            jobs.stream_into_snapshot(source, root, state).trigger(availableNow=True).start().awaitTermination()
        found.append(tables(spark, root))
    assert found[0] == found[1] == found[2]
    assert len(found[0]["places"]) == 3 and len(found[0]["refs"]) == 3 and len(found[0]["aliases"]) == 7
    # the last batch is offered once more, as after a failure between its version and the stream's own log
    newest = sorted(r.path for r in spark.read.format("binaryFile").load(f"{state}/commits/*").select("path").collect())[-1]
    fs, path, _ = snapshot._fs(spark, newest)
    fs.delete(path, False)
    jobs.stream_into_snapshot(source, root, state).trigger(availableNow=True).start().awaitTermination()
    assert tables(spark, root) == found[0]
