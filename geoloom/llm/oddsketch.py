"""Near-duplicate documents: MinHash bands for candidates, odd sketches to weigh them, full sets to confirm."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoloom.llm.components import connected
from geoloom.llm.store import batches_of, if_small, ship_by_value, staged

ship_by_value(__name__)

SLICE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0d]")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


BYTES = stream(1, 256)
POWERS = stream(2, 256) | U(1)
PLACES = stream(3, 64) | U(1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased UTF-8 bytes, slice by slice."""
    found, start = [], 0
    while start < len(data):
        cut = BLANK.search(data, start + SLICE)
        end = cut.end() if cut else len(data)
        raw = np.frombuffer(data, np.uint8, end - start, start)
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        at = np.flatnonzero(solid)
        if len(at):
            first = np.flatnonzero(solid[at] & np.r_[True, at[1:] != at[:-1] + 1])
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            # a place beyond the table takes its power from two of its entries
            power = POWERS[place & 255] * (POWERS[(place >> 8) & 255] if len(place) and place.max() > 255 else U(1))
            if len(place) and place.max() > 65535:
                power = power * (mix((place >> 16).astype(U) + U(7)) | U(1))
            found.append(mix(np.add.reduceat(BYTES[raw[at]] * power, first)))
        start = end
    return np.concatenate(found) if found else np.empty(0, U)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; the whole sequence where it has fewer words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    wide = min(width, len(words))
    n = len(words) - wide + 1
    total = reduce(np.add, (words[k : k + n] * PLACES[k] for k in range(wide)))
    return np.unique(mix(total + U(wide)))


def folder(width: int, bands: int, rows: int, bins: int, bits: int):
    """A task that turns texts into set digests, band keys and odd sketches."""
    k = bands * rows
    mult = (stream(5, k) >> U(32)).astype(np.uint32) | np.uint32(1)
    add = (stream(6, k) >> U(32)).astype(np.uint32)
    shift, names = U(64 - (bins.bit_length() - 1)), stream(7, bands)

    def one(text):
        got = shingle_hashes(text, width)
        if not len(got):
            return 0, None, 0, None, None
        low = got.astype(np.uint32)
        least = reduce(np.minimum, ((low[i : i + 512, None] * mult + add).min(axis=0) for i in range(0, len(low), 512)))
        keys = names.copy()
        for column in least.reshape(bands, rows).T.astype(U):
            keys = mix((keys ^ column) * U(0x9E3779B97F4A7C15))
        # one-permutation samples: the smallest hash of each bin, folded into parities
        bin_of = got >> shift
        sample = got[np.r_[True, bin_of[1:] != bin_of[:-1]]]
        parity = np.bincount((mix(sample) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
        sketch = np.packbits(parity.astype(np.uint8)).view(np.int64)
        return len(got), hashlib.blake2b(got.tobytes(), digest_size=16).digest(), len(sample), sketch.tolist(), keys.view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for b in batches:
            got = list(zip(*map(one, b.column(2).to_pylist()), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(got, kinds, strict=True))], names=["doc_id", "tag", "n_shingles", "digest", "n_samples", "sketch", "bands"])

    return run


def lister(width: int, most: int):
    """A task that gives 32 bits of each shingle's hash, for sets of at most ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = []
            for text in b.column(2).to_pylist():
                got = shingle_hashes(text, width)
                short.append(np.unique(got.astype(np.uint32)).view(np.int32) if len(got) <= most else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(short, pa.list_(pa.int32()))], names=["node", "tag", "short"])

    return run


def confirmer(width: int, percent: int, remembered: int = 1 << 21):
    """A task that keeps the pairs whose full sets are similar enough. Sets are remembered up to a number of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        for b in batches:
            keep = []
            for a, ta, c, tc, left, right in zip(*(x.to_pylist() for x in b.columns), strict=True):
                pair = []
                for name, text in (((a, ta), left), ((c, tc), right)):
                    if name not in sets:
                        if held > remembered:
                            sets, held = {}, 0
                        sets[name] = shingle_hashes(text, width)
                        held += len(sets[name])
                    pair.append(sets[name])
                mine, other = pair
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield b.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    return run


def looks_close(x: str, y: str, percent: int, bins: int, bits: int, miss_sd: float) -> Column:
    """Whether two odd sketches leave room for the wanted similarity.

    The population count of the XOR gives the number of differing samples, and with it the
    matching ones. At the threshold the two set sizes fix the size of the union, the number
    of bins it fills, and so the matches to expect; more similar sets have more. Matches
    scatter by the bins really filled, by sampling (less where nearly all of a set is sampled) and by parities that
    cancel; a pair is turned down only when it is ``miss_sd`` standard deviations below, and
    further where few shared bins skew the lower tail.
    """
    ones = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(bits // 64)))
    differ = F.lit(-bits / 2) * F.log(F.greatest(F.lit(1) - ones * F.lit(2.0 / bits), F.lit(1e-6)))
    match = (F.col(f"{x}.n_samples") + F.col(f"{y}.n_samples") - differ) / 2
    j = percent / 100
    union = (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles")) / (1 + j)
    filled = F.lit(float(bins)) * (1 - F.exp(-union / bins))
    apart = filled * (2 * (1 - j))
    noise = F.lit(bits / 4) * (F.exp(apart * (4.0 / bits)) - 1) - apart + 1
    full = union / bins
    shared = F.lit(float(bins)) * (F.exp(-full) - (1 + full) * F.exp(-2 * full))
    spread = filled * (j * (1 - j)) * F.greatest(F.lit(1.0) - filled / union, F.lit(0.0)) + noise / 4 + 0.25 + shared * j**2
    skew = shared * (j**3 * (miss_sd**2 - 1) / 6) / spread
    sizes = F.least(f"{x}.n_shingles", f"{y}.n_shingles") * 100 >= F.greatest(f"{x}.n_shingles", f"{y}.n_shingles") * percent
    return sizes & (match + F.sqrt(spread) * miss_sd + skew >= filled * j)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, bands: int = 48, rows: int = 5, bins: int = 2048, bits: int = 4096, miss_sd: float = 5.0, tries: int = 4, block: int = 2048, short: int = 1024, share: int = 64, small_ids: int = 2_000_000) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents with equal shingle sets form a class and only one of the smallest id goes on. Classes
    that share a band key are candidates; at the threshold all ``bands`` miss with
    probability ``(1 - (percent/100)**rows)**bands`` (2e-6 as set). Round one compares each
    class with the smallest members of its buckets, the ``tries`` that it meets most often, and
    confirms the best such pair on the full sets. Round two looks at buckets whose members are in more than one component:
    pairs across components that the odd sketches leave open are counted out on 32 bits of each
    hash where both sets have at most ``short`` shingles, which loses no pair and leaves few
    that are not near; the others and what is left are confirmed. So a group of many texts a little below the threshold gives no rows.
    Pairs within a component need no look, so a group of near copies costs a few pairs per member.
    Buckets above ``block`` members are compared in parts, and pairs of one document above ``share``, spread over tasks.
    Confirmation compares sets of 64-bit hashes of the shingles.

    Null and empty texts have no shingles and are linked with nothing. A row without an id
    takes the component of its class and is linked with nothing else (null if no row of the
    class has an id, and then kept). Rows with the same id are one document, linked with all that any of its texts is near to. Other columns
    are ignored.
    """
    with batches_of(docs.sparkSession, 256):
        return _near_duplicates(docs, id_col, text_col, width, percent, bands, rows, bins, bits, miss_sd, tries, block, short, share, small_ids)


def _near_duplicates(docs, id_col, text_col, width, percent, bands, rows, bins, bits, miss_sd, tries, block, short, share, small_ids):
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    made = staged(
        own.select("doc_id", "tag", "text").mapInArrow(folder(width, bands, rows, bins, bits), "doc_id long, tag long, n_shingles long, digest binary, n_samples long, sketch array<long>, bands array<long>"),
        "features",
    )
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("node"), "tag"))).alias("name")
    classes = staged(
        made.where("digest is not null").groupBy("digest").agg(named, *(F.first(c).alias(c) for c in ("n_shingles", "n_samples", "sketch", "bands"))).select("digest", "name.node", "name.tag", "n_shingles", "n_samples", "sketch", "bands"),
        "classes",
    )
    nodes = classes.where("node is not null")
    sketches = nodes.select("node", "tag", "n_shingles", "n_samples", "sketch")
    keyed = nodes.select("node", "tag", F.explode("bands").alias("key"))
    shared = staged(keyed.groupBy("key").agg(F.min(F.struct("node", "tag")).alias("hub"), F.count("*").alias("size")).where("size > 1"), "shared")
    members = staged(keyed.join(shared, "key"), "members")
    # few bytes but much work: as many tasks as shuffles have
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sketch_of(name: str) -> DataFrame:
        return sketches.select(F.col("node").alias(name), F.col("tag").alias(f"t{name}"), F.struct("n_shingles", "n_samples", "sketch").alias(f"{name}_s"))

    def texts_of(ids: DataFrame) -> DataFrame:
        """``(node, tag, text)`` of some documents."""
        ids = ids.select(F.col("node").alias("doc_id"), "tag")
        found = own.join(if_small(ids, small_ids), ["doc_id", "tag"], "left_semi").groupBy("doc_id", "tag").agg(F.first("text").alias("text"))
        return found.withColumnRenamed("doc_id", "node")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` whose whole texts are similar enough."""
        ids = pairs.select(F.col("a").alias("node"), F.col("ta").alias("tag")).union(pairs.select("b", "tb")).distinct()
        text = staged(texts_of(staged(ids, "ids")), "texts")
        side = [text.select(F.col("node").alias(x), F.col("tag").alias(f"t{x}"), F.col("text").alias(f"text_{x}")) for x in "ab"]
        # the pairs of a hub are dealt over parts, each with a copy of its text
        hubs = pairs.groupBy("a", "ta").count().where(F.col("count") > share).select("a", "ta", F.ceil(F.col("count") / share).alias("parts"))
        part = F.pmod(F.xxhash64("b", "tb"), F.coalesce("parts", F.lit(1)))
        dealt = staged(pairs.join(hubs, ["a", "ta"], "left").select("a", "ta", "b", "tb", part.alias("part")), "dealt")
        copies = dealt.select("a", "ta", "part").distinct().join(side[0], ["a", "ta"])
        both = dealt.join(side[1], ["b", "tb"]).repartition(tasks, "a", "ta", "part").join(copies, ["a", "ta", "part"])
        return both.select("a", "ta", "b", "tb", "text_a", "text_b").mapInArrow(confirmer(width, percent), "a long, b long")

    # of the buckets' smallest members, those that a class meets in most bands
    often = members.where("node <> hub.node").groupBy("node", "tag", "hub").count()
    rank = F.row_number().over(W.partitionBy("node", "tag").orderBy(F.desc("count"), "hub"))
    stars = often.withColumn("r", rank).where(F.col("r") <= tries).select(F.col("hub.node").alias("a"), F.col("hub.tag").alias("ta"), F.col("node").alias("b"), F.col("tag").alias("tb"))
    stars = stars.join(sketch_of("a"), ["a", "ta"]).join(sketch_of("b"), ["b", "tb"]).where(looks_close("a_s", "b_s", percent, bins, bits, miss_sd))
    apart = F.bit_count(F.col("a_s.sketch")[0].bitwiseXOR(F.col("b_s.sketch")[0]))
    for i in range(1, bits // 64):
        apart = apart + F.bit_count(F.col("a_s.sketch")[i].bitwiseXOR(F.col("b_s.sketch")[i]))
    best = staged(stars.groupBy("b", "tb").agg(F.min_by(F.struct("a", "ta"), apart).alias("x")).select("x.a", "x.ta", "b", "tb"), "best")
    links = staged(confirmed(best), "links")
    first = staged(connected(links), "first")

    placed = members.join(first.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "tag", "size", F.coalesce("component", "node").alias("comp"))
    placed = staged(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    left_open = staged(placed.join(mixed, "key"), "unsettled")
    lists = staged(texts_of(staged(left_open.select("node", "tag").distinct(), "ids")).mapInArrow(lister(width, short), "node long, tag long, short array<int>"), "short")
    known = nodes.join(lists, ["node", "tag"]).select("node", "tag", F.struct("n_shingles", "n_samples", "sketch", "bands", "short").alias("s"))
    open_rows = staged(left_open.join(known, ["node", "tag"]), "open")
    parts = F.ceil(F.col("size") / block).cast("int")
    left = open_rows.withColumn("part", F.pmod(F.xxhash64("node", "tag"), parts).cast("int")).alias("x")
    right = open_rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    # a pair that shares several buckets is given in the one of the smallest key
    once = F.array_min(F.array_intersect("x.s.bands", "y.s.bands")) == F.col("x.key")
    # elements that share 32 bits with another of their set may stand behind one common number
    hidden = F.least(*(F.col(f"{x}.s.n_shingles") - F.size(f"{x}.s.short") for x in "xy"))
    common = F.size(F.array_intersect("x.s.short", "y.s.short")) + hidden
    counted = F.lit(100) * common >= (F.col("x.s.n_shingles") + F.col("y.s.n_shingles") - common) * percent
    possible = F.col("x.s.short").isNull() | F.col("y.s.short").isNull() | counted
    cross = left.join(right, meet & looks_close("x.s", "y.s", percent, bins, bits, miss_sd) & once & possible)
    cross = cross.select(F.col("x.node").alias("a"), F.col("x.tag").alias("ta"), F.col("y.node").alias("b"), F.col("y.tag").alias("tb"))
    more = staged(confirmed(staged(cross, "cross")), "links")
    found = connected(links.union(more)).withColumnRenamed("id", "node")

    component = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return (
        made.select("doc_id", "n_shingles", "digest")
        .join(component, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
