"""Readers: GeoTIFF tiles, GeoJSON, KML, paged services recorded as files, and CSV tables."""
