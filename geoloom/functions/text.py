"""Names and keys of places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom import rules
from geoloom.functions.core import ColumnOrName, blank_to_null, col, first_non_empty, let


def normalize_name(name: ColumnOrName) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col(name), F.lit("")))), r"[^\p{L}\p{Nd}]", "")


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each text in its order."""

    def keep(vs: Column) -> Column:
        lows = F.transform(vs, lambda v: F.lower(v))
        return let(
            lows,
            lambda ls: F.filter(vs, lambda v, i: F.array_position(ls, F.get(ls, i)) == i + 1),
        )

    return let(values, keep)


def tag(tags: ColumnOrName, key: str) -> Column:
    return F.coalesce(F.trim(F.try_element_at(col(tags), F.lit(key))), F.lit(""))


def best_name(tags: ColumnOrName) -> Column:
    return F.coalesce(first_non_empty(tag(tags, "name:uk"), tag(tags, "name")), F.lit(""))


def name_aliases(tags: ColumnOrName) -> Column:
    """All spellings under the name tags, split at semicolons, first ones kept."""
    parts = F.flatten(F.array(*[F.split(tag(tags, k), ";") for k in rules.NAME_TAGS]))
    return distinct_ignoring_case(F.filter(F.transform(parts, lambda v: F.trim(v)), lambda v: v != ""))


def first_tag(tags: ColumnOrName, keys: tuple[str, ...]) -> Column:
    return F.coalesce(first_non_empty(*[tag(tags, k) for k in keys]), F.lit(""))


def usable_name(name: ColumnOrName) -> Column:
    """False for blank names and names holding one of the stop words."""
    low = F.lower(F.trim(col(name)))
    hit = F.lit(False)
    for word in rules.NAME_STOP_WORDS:
        hit = hit | low.contains(word)
    return F.coalesce((low != "") & ~hit, F.lit(False))


def allowed_place(place: ColumnOrName) -> Column:
    return F.coalesce(F.lower(col(place)).isin(*rules.PLACE_CLASSES), F.lit(False))


def allowed_boundary(boundary: ColumnOrName, level: ColumnOrName) -> Column:
    return F.coalesce(
        (F.lower(col(boundary)) == "administrative") & col(level).isin(*rules.BOUNDARY_LEVELS), F.lit(False)
    )


def place_type_filter(place: ColumnOrName, boundary: ColumnOrName, level: ColumnOrName) -> Column:
    return allowed_place(place) | allowed_boundary(boundary, level)


def search_text(*parts: ColumnOrName) -> Column:
    """Non-blank parts joined by commas, repeated ones once."""
    present = F.filter(F.array(*[blank_to_null(p) for p in parts]), lambda v: v.isNotNull())
    return F.array_join(distinct_ignoring_case(present), ", ")


def entity_key(
    osm_type: ColumnOrName, osm_id: ColumnOrName, provider: ColumnOrName, external_id: ColumnOrName,
    name: ColumnOrName, place: ColumnOrName, x: ColumnOrName, y: ColumnOrName,
) -> Column:
    """OSM key, else provider key, else name, class and rounded point, else name
    and class."""
    whole = lambda v: F.format_string("%.0f", col(v))
    return F.coalesce(
        F.when(col(osm_id) > 0, F.concat_ws(":", F.lit("osm"), F.coalesce(col(osm_type), F.lit("")), col(osm_id))),
        F.when(blank_to_null(provider).isNotNull() & blank_to_null(external_id).isNotNull(),
               F.concat_ws(":", col(provider), col(external_id))),
        F.when(col(x).isNotNull(), F.concat_ws(":", col(name), col(place), whole(x), whole(y))),
        F.concat_ws(":", col(name), col(place)),
    )


def geometry_key(place_key: ColumnOrName, zone: ColumnOrName, ring_text: ColumnOrName) -> Column:
    t = col(ring_text)
    return F.concat_ws("|", col(place_key), col(zone).cast("string"), F.hex(F.xxhash64(t)), F.length(t).cast("string"))
