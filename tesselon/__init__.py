"""Raster and point analytics as Spark plans."""
