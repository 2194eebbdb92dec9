"""Geospatial analytics expressed as Spark DataFrame jobs."""
