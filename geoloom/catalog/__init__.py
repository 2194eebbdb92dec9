"""Queries over the shared tables, grouped by area."""

from geoloom.registry import ORACLES, QUERIES
from geoloom.catalog import areas, matching, measure, merging, places, quality, responses, snapshots, sources, spatial, stores, tiles, tracks  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
