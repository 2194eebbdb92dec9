"""Encoded polyline text as column expressions (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import ColumnOrName, col, let

CHUNK = r"[_-\x7f]*[?-\^]"  # continuation characters, then one closing character
BLOCK = 64


def _chunk_value(chunk: Column) -> Column:
    """Signed number of one chunk: 5 bits per character, lowest first, zigzag."""
    raw = F.aggregate(
        F.split(F.reverse(chunk), ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: F.when(ch == "", acc).otherwise(acc * 32 + ((F.ascii(ch) - 63) % 32)),
    )
    return let(
        raw,
        lambda v: F.when(v % 2 == 1, -F.call_function("shiftright", v + 1, F.lit(1))).otherwise(
            F.call_function("shiftright", v, F.lit(1))
        ),
    )


def prefix_sums(values: Column) -> Column:
    """Running sums of a bigint array: short runs first, then their offsets."""
    empty = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")

    def runs(v: Column) -> Column:
        blocks = F.ceil(F.size(v) / BLOCK).cast("int")
        return F.transform(
            F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>")),
            lambda b: F.aggregate(
                F.slice(v, b * BLOCK + 1, F.lit(BLOCK)),
                empty,
                lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), zero) + x),
            ),
        )

    def offsets(r: Column) -> Column:
        return F.aggregate(
            r, F.array(zero), lambda acc, run: F.array_append(acc, F.element_at(acc, -1) + F.element_at(run, -1))
        )

    return let(
        let(values, runs),
        lambda r: let(
            offsets(r),
            lambda o: F.flatten(F.transform(r, lambda run, i: F.transform(run, lambda x: x + F.get(o, i)))),
        ),
    )


def decode(text: ColumnOrName) -> Column:
    """Array of (lat, lng) structs. A text that ends after a latitude repeats the
    last longitude."""
    chunks = F.regexp_extract_all(col(text), F.lit(CHUNK), F.lit(0))
    deltas = F.transform(chunks, _chunk_value)

    def axis(d: Column, start: int) -> Column:
        picked = F.filter(d, lambda _, i: i % 2 == start)
        return prefix_sums(picked)

    def pair(lat: Column, lng: Column) -> Column:
        return F.transform(
            lat,
            lambda v, i: F.struct(
                (v * F.lit(1e-5)).alias("lat"),
                (F.coalesce(F.get(lng, i), F.try_element_at(lng, F.lit(-1)), F.lit(0)) * F.lit(1e-5)).alias("lng"),
            ),
        )

    return let(deltas, lambda d: let(axis(d, 0), lambda a: let(axis(d, 1), lambda o: pair(a, o))))


def scaled(degrees: ColumnOrName) -> Column:
    """Degrees as a whole number of 1e-5 steps, halves to even."""
    return F.bround(col(degrees) * 1e5, 0).cast("bigint")


def zigzag(delta: Column) -> Column:
    return F.when(delta < 0, delta * -2 - 1).otherwise(delta * 2)


def encode_step(step: ColumnOrName) -> Column:
    """Text of one :func:`zigzag` step; its column is read often, so it should be one of the row."""
    z = col(step)


    def group(i: int) -> Column:
        rest = F.call_function("shiftright", z, F.lit(5 * i))
        sign = F.char(rest.bitwiseAND(F.lit(31).cast("bigint")) + F.when(rest >= 32, 95).otherwise(63))
        return sign if i == 0 else F.when(rest > 0, sign).otherwise("")

    # a bigint has at most 13 groups; few steps have more than six. Written out, they are compiled
    short = F.concat(*[group(i) for i in range(6)])
    return F.when(z < 1 << 30, short).when(z.isNotNull(), F.concat(short, *[group(i) for i in range(6, 13)]))
