"""Writers: GeoJSON, KML, HTML, CSV, GeoTIFF and append-only stores."""
