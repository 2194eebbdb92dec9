"""Streaming forms of the track, counter and snapshot jobs."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from geoloom.functions.geodesy import WGS84_AXIS, bearing, distance_km
from geoloom.operators.merging import merge_aliases, merge_snapshots
from geoloom.session import cut_lineage
from geoloom.sources.snapshot import from_documents, pointer, read_snapshot, write_snapshot

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEGS = "session bigint, ts timestamp, lat double, lng double, prev_lat double, prev_lng double"
LAST = "ts timestamp, lat double, lng double"
SILENT_MS = 30 * 24 * 3600 * 1000  # event time after which a silent session is forgotten


def _pair_up(key, batches, state: GroupState):
    """Ties each fix to the one before it; keeps the last fix of the session."""
    if state.hasTimedOut:
        state.remove()
        return
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
    before = state.get if state.exists else (None, None, None)
    if before[0] is not None:
        # a fix older than the last one kept came too late for its leg
        pdf = pdf[pdf["ts"] >= before[0]]
    if pdf.empty:
        return
    out = pd.DataFrame({"session": key[0], "ts": pdf["ts"], "lat": pdf["lat"], "lng": pdf["lng"]})
    out["prev_lat"], out["prev_lng"] = pdf["lat"].shift(1), pdf["lng"].shift(1)
    out.iloc[0, out.columns.get_loc("prev_lat")] = before[1]
    out.iloc[0, out.columns.get_loc("prev_lng")] = before[2]
    last = pdf.iloc[-1]
    state.update((last["ts"].to_pydatetime(), float(last["lat"]), float(last["lng"])))
    silent = int(pd.Timestamp(last["ts"]).timestamp() * 1000) + SILENT_MS
    state.setTimeoutTimestamp(max(silent, state.getCurrentWatermarkMs() + 1))
    yield out.astype({"prev_lat": "float64", "prev_lng": "float64"})


def stream_track_legs(fixes: DataFrame, lateness: str = "10 minutes", axis: float = WGS84_AXIS) -> DataFrame:
    """Legs of GPS fixes (session, event_id, ts, lat, lng) as they arrive. The state
    per session is one fix; silent sessions are forgotten."""
    src = fixes.select("session", "event_id", F.col("ts").cast("timestamp").alias("ts"), "lat", "lng")
    paired = src.withWatermark("ts", lateness).groupBy("session").applyInPandasWithState(
        _pair_up, LEGS, LAST, "append", GroupStateTimeout.EventTimeTimeout
    )
    return paired.select(
        "session", "ts", "lat", "lng",
        distance_km("prev_lat", "prev_lng", "lat", "lng", axis).alias("leg_km"),
        bearing("prev_lat", "prev_lng", "lat", "lng").alias("leg_bearing"),
    )


HELD = pa.schema([("session", pa.int64()), ("nameless", pa.bool_()), ("micros", pa.int64()), ("event_id", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64())])
SESSION = ["nameless", "session"]


class LegsInOrder(StatefulProcessor):
    """Holds back the fixes of a part of the sessions until the watermark has passed them, then pairs them in order.

    The state is the fixes within the lateness, a chunk for each batch, and the last fix paired of each
    session; one timer wakes it at the oldest fix held or when a session has been silent for ``idle_ms``, which
    is then forgotten. A fix that comes later than that after the one before starts a new track,
    whether or not the state was cleared.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "chunk binary")
        self.last = handle.getValueState("last", "chunk binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        oldest = None
        for part in rows:
            self.held.appendValue((packed(part),))
            first = int(part["micros"].min())
            oldest = first if oldest is None else min(first, oldest)
        if oldest is not None:
            self.wake(oldest, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, idle = timerValues.getCurrentWatermarkInMs() * 1000, self.idle_ms * 1000
        held = pd.concat([unpacked(b) for (b,) in self.held.get()] or [HELD.empty_table().to_pandas()], ignore_index=True)
        due, wait = held[held["micros"] <= passed], held[held["micros"] > passed]
        last = unpacked(self.last.get()[0]) if self.last.exists() else held[:0]
        fixes = pd.concat([last.assign(new=False), due.assign(new=True)], ignore_index=True).sort_values([*SESSION, "new", "micros", "event_id", "lat", "lng"], kind="stable")
        before = fixes.groupby(SESSION, sort=False)[["micros", "lat", "lng"]].shift(1)
        near = fixes["micros"] - before["micros"].fillna(0).astype("int64") <= idle
        fixes["prev_lat"], fixes["prev_lng"] = before["lat"].where(near & before["micros"].notna()), before["lng"].where(near & before["micros"].notna())
        newest = fixes.drop_duplicates(SESSION, keep="last")
        newest = newest[newest["micros"] + idle >= passed]
        if len(due):
            self.held.put([(packed(wait),)]) if len(wait) else self.held.clear()
        if len(newest):
            self.last.update((packed(newest),))
        elif len(last):
            self.last.clear()
        if len(wait) or len(newest):
            self.wake(int(pd.concat([wait["micros"], newest["micros"] + idle]).min()), timerValues)
        out = fixes[fixes["new"]]
        if len(out):
            yield out[["session", "nameless", "micros", "lat", "lng", "prev_lat", "prev_lng"]]

    def wake(self, micros: int, timer_values) -> None:
        """Keep one timer, the earliest, beside any that is due now (and still listed while it is handled)."""
        now = timer_values.getCurrentWatermarkInMs()
        at, known = max(-(-micros // 1000), now + 1), [t for t in self.handle.listTimers() if t > now]
        if all(at < t for t in known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def packed(fixes: pd.DataFrame) -> bytes:
    return pa.RecordBatch.from_pandas(fixes[HELD.names], HELD, preserve_index=False).serialize().to_pybytes()


def unpacked(chunk: bytes) -> pd.DataFrame:
    return pa.ipc.read_record_batch(pa.py_buffer(bytes(chunk)), HELD).to_pandas()


def stream_legs_in_order(
    fixes: DataFrame, lateness: str = "10 minutes", idle_ms: int = 30 * 24 * 3600 * 1000, axis: float = WGS84_AXIS, parts: int = 512
) -> DataFrame:
    """Legs of GPS fixes (session, event_id, ts, lat, lng) in the order of their times.

    However fixes are dealt over batches, and in whatever order they arrive within the
    lateness, the legs are the same; each is given once, when the watermark has passed its fix. Fixes later than that, or
    without time, are dropped. Needs the RocksDB state store (:func:`rocksdb_state`). Sessions are held in ``parts``, as each access to
    the state of a key costs a call; a running stream keeps the number it began with.
    """
    src = fixes.select(
        F.coalesce("session", F.lit(0)).cast("bigint").alias("session"), F.col("session").isNull().alias("nameless"),
        F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"),
    ).withColumns({"micros": F.unix_micros("ts"), "part": F.pmod(F.xxhash64("session", "nameless"), F.lit(parts))})
    paired = src.filter(F.col("ts").isNotNull()).withWatermark("ts", lateness).groupBy("part").transformWithStateInPandas(
        LegsInOrder(idle_ms), "session bigint, nameless boolean, micros bigint, lat double, lng double, prev_lat double, prev_lng double", "append", "EventTime"
    )
    return paired.select(
        F.when(~F.col("nameless"), F.col("session")).alias("session"), F.timestamp_micros("micros").alias("ts"), "lat", "lng",
        distance_km("prev_lat", "prev_lng", "lat", "lng", axis).alias("leg_km"),
        bearing("prev_lat", "prev_lng", "lat", "lng").alias("leg_bearing"),
    )


def rocksdb_state(spark) -> None:
    """Set the state store that keyed list and value states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_hit_counts(hits: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", ts: str = "ts", source: str = "source") -> DataFrame:
    """Tile hits per source and time window; a new window is the counter's reset."""
    w = hits.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", lateness)
    g = w.groupBy(F.window("__ts", window).alias("w"), source).agg(F.count(F.lit(1)).alias("hits"))
    return g.select(F.col("w.start").alias("window_start"), source, "hits")


def stream_latest_request(requests: DataFrame, key: str = "view", generation: str = "generation") -> DataFrame:
    """Newest generation per view; stale requests never replace it. One number and
    row per view is the state (update mode)."""
    rest = [c for c in requests.columns if c not in (key, generation)]
    g = requests.groupBy(key).agg(F.max(F.struct(F.col(generation), *[F.col(c) for c in rest])).alias("__b"))
    return g.select(key, f"__b.{generation}", *[f"__b.{c}" for c in rest])


def stream_merge_snapshots(parts: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Merge partial snapshots into the held one, batch by batch. ``merge`` gets
    the rows of a batch and its number; it must be safe to repeat a batch, which
    writing a version named by the batch number gives."""
    return parts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def stream_into_snapshot(parts: DataFrame, root: str, checkpoint: str):
    """Merge nested place documents into the five-table snapshot under ``root`` as they arrive.

    Each batch is one version of the store, and its number goes into the pointer with it: both
    become current in the same rename. A batch that is repeated, after a
    failure at any moment, is skipped if its number is there and written anew if not.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = pointer(spark, root) or {}
        done = state.get("batches", {})
        if done.get(stream, -1) >= number:
            return
        incoming = from_documents(cut_lineage(batch))
        held = read_snapshot(spark, root) if state else type(incoming)(*(df.limit(0) for df in vars(incoming).values()))
        merged = merge_snapshots(held, incoming)
        # names stand among the aliases as the next merge would have them, so the number of batches leaves no trace
        names = merged.places.select("place_id", F.lit(1_000_000).alias("seq"), F.col("name").alias("alias"))
        merged = replace(merged, aliases=merge_aliases(merged.aliases.unionByName(names), incoming.aliases.limit(0)))
        write_snapshot(merged, root, f"{stream}-{number:09d}", batches={**done, stream: number})

    return stream_merge_snapshots(parts, merge, checkpoint)
