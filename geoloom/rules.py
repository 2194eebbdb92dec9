"""Fixed values of place conflation: providers, limits by place class, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import ColumnOrName, col

# providers and their default priority
OSM = "OpenStreetMap/Overpass"
GEOAPIFY = "Geoapify/Boundaries"
AZURE = "Azure Maps/Polygon"
GOOGLE = "Google/Geocoding (POC)"
BING = "Bing Maps/Locations"
GRAPHHOPPER = "GraphHopper/Geocoding"
LEGACY = "Legacy cache"
PRIORITIES = {AZURE: 120, OSM: 115, GEOAPIFY: 105, GOOGLE: 85, BING: 80, GRAPHHOPPER: 75}
MAP_GEOCODER_PREFIX = "Map geocoder/"
MAP_GEOCODER_PRIORITY = 60
LEGACY_PRIORITY = 10

# place classes: identity distance m, link tolerance m, least and greatest area km2
PLACE_CLASSES = {
    "city": (8000.0, 2000.0, 0.5, 5000.0),
    "town": (5000.0, 1000.0, 0.1, 1000.0),
    "village": (2500.0, 500.0, 0.02, 250.0),
    "hamlet": (1500.0, 300.0, 0.005, 50.0),
    "isolated_dwelling": (800.0, 200.0, 0.001, 10.0),
}
OTHER_CLASS = (2000.0, 500.0, 0.005, 5000.0)
BOUNDARY_LEVELS = ("9", "10", "11")
SAME_SPOT_M = 250.0
CLEAR_LEAD_M = 500.0
MAX_IDENTITY_M = 8000.0
RESIDENTIAL_LIMIT_M = 8000.0

# words that mark an administrative unit, a street or a site rather than a settlement
NAME_STOP_WORDS = (
    "область", "район", "громада", "територіальна громада", "міська громада", "сільська громада",
    "селищна громада", "міська рада", "сільська рада", "селищна рада", "вулиця", "вул.", "площа",
    "дорога", "шосе", "стадіон", "парк", "кладовище", "урочище",
)
NAME_TAGS = (
    "name", "name:uk", "name:en", "name:ru", "official_name", "short_name", "alt_name", "old_name",
)
REGION_TAGS = ("addr:region", "is_in:state", "is_in:region")
DISTRICT_TAGS = ("addr:district", "is_in:district")
# ---- end of fixed values ----


def _by_class(place: ColumnOrName, index: int) -> Column:
    key = F.lower(F.trim(col(place)))
    out = None
    for name, values in PLACE_CLASSES.items():
        out = F.when(key == name, F.lit(values[index])) if out is None else out.when(key == name, F.lit(values[index]))
    return out.otherwise(F.lit(OTHER_CLASS[index]))


def identity_distance(place: ColumnOrName) -> Column:
    return _by_class(place, 0)


def link_tolerance(place: ColumnOrName) -> Column:
    return _by_class(place, 1)


def least_area(place: ColumnOrName) -> Column:
    return _by_class(place, 2)


def greatest_area(place: ColumnOrName) -> Column:
    return _by_class(place, 3)


def classify_source(source: ColumnOrName) -> Column:
    """Source text to provider: blank or 'local' is the old cache, 'multi-provider'
    names none."""
    s = F.trim(col(source))
    low = F.lower(s)
    return (
        F.when(s.isNull() | (s == "") | (low == "local"), F.lit(LEGACY))
        .when(low == "multi-provider", F.lit(""))
        .when(low.contains("overpass") | low.contains("openstreetmap"), F.lit(OSM))
        .otherwise(s)
    )


def source_priority(source: ColumnOrName, geocoder_prefix: str = MAP_GEOCODER_PREFIX) -> Column:
    """Default priority of a provider; a handful of literals, no lookup join."""
    key = F.lower(classify_source(source))
    out = None
    for name, p in PRIORITIES.items():
        out = F.when(key == name.lower(), F.lit(p)) if out is None else out.when(key == name.lower(), F.lit(p))
    return out.when(key.startswith(geocoder_prefix.lower()), F.lit(MAP_GEOCODER_PRIORITY)).otherwise(F.lit(LEGACY_PRIORITY))

# fixed values: points and thresholds of polygon and center scores, reasons shown to users
CONTAINS_CENTER_POINTS = 35
LINK_POINTS = 20
NO_CENTER_POINTS = -25
VERTEX_POINTS_LIMIT = 20
SMALL_AREA_POINTS = -35
LARGE_AREA_POINTS = -60
AREA_POINTS = 10
COMPACT_POINTS = 5
LOOSE_POINTS = -10
LEAST_COMPACTNESS = 0.02
OTHERS_TO_REJECT = 2
AGREE_M, AGREE_POINTS = 3000.0, 8
DISAGREE_M, DISAGREE_POINTS = 25000.0, -12
CENTER_INSIDE_POINTS = 30
PLACE_NODE_POINTS = 20
SAME_CENTER_M = 1.0
SAME_INSTANCE_M = 100.0
LEAST_RING_AREA = 1.0
REASONS = {
    "broken": "Контур містить пошкоджене або незамкнене кільце",
    "outer": "Зовнішнє кільце контуру пошкоджене",
    "outer_cross": "Зовнішнє кільце контуру має самоперетини",
    "hole": "Внутрішнє кільце контуру пошкоджене",
    "hole_cross": "Внутрішнє кільце контуру має самоперетини",
    "hole_outside": "Внутрішнє кільце розташоване поза контуром",
    "hole_meets_outer": "Внутрішнє кільце перетинає зовнішню межу",
    "holes_meet": "Внутрішні кільця контуру перетинаються",
    "no_center": "Контур не містить центр власного НП",
    "small": "Площа контуру %s км² менша допустимої %s км²",
    "large": "Площа контуру %s км² перевищує допустимі %s км²",
    "others": "Контур охоплює %d інших НП",
}
# ---- end of fixed values ----
