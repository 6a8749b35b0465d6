"""Text documents made of rows.  Rows become strings in columns; one file is written by one task, renamed into place."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRS_NAME = "urn:ogc:def:crs:EPSG::2056"


def point_feature(x: Column, y: Column, properties: Column, digits: int = 2) -> Column:
    """A GeoJSON point feature."""
    place = F.struct(F.lit("Point").alias("type"), F.array(F.bround(x, digits), F.bround(y, digits)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), place.alias("geometry")))


def feature_collection(features: DataFrame, name: str, feature: str = "feature", order: str | None = None) -> DataFrame:
    """One row, one document.  For label files, which are reviewed by people and so fit a value."""
    parts = F.collect_list(F.struct(*([F.col(order).alias("o")] if order else []), F.col(feature).alias("f")))
    joined = F.array_join(F.transform(F.array_sort(parts), lambda p: p["f"]), ",")
    head = f'{{"type":"FeatureCollection","name":"{name}","crs":{{"type":"name","properties":{{"name":"{CRS_NAME}"}}}},"features":['
    return features.agg(F.concat(F.lit(head), joined, F.lit("]}")).alias("document"))


def kml_point(name: Column, colour: Column, lon: Column, lat: Column, note: Column) -> Column:
    style = F.format_string("<Style><IconStyle><color>%s</color></IconStyle></Style>", colour)
    return F.format_string("<Placemark><name>%s</name><description>%s</description>%s<Point><coordinates>%.8f,%.8f,0</coordinates></Point></Placemark>", escaped(name), escaped(note), style, lon, lat)


def kml_polygon(name: Column, colour: Column, ring: Column, fill_alpha: str = "33") -> Column:
    """``ring``: an array of lon and lat structs; it is closed here."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    text = F.array_join(F.transform(closed, lambda p: F.format_string("%.8f,%.8f,0", p["lon"], p["lat"])), " ")
    style = F.format_string(f"<Style><LineStyle><color>%s</color></LineStyle><PolyStyle><color>{fill_alpha}%s</color></PolyStyle></Style>", colour, F.substring(colour, 3, 6))
    return F.format_string("<Placemark><name>%s</name>%s<Polygon><outerBoundaryIs><LinearRing><coordinates>%s</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>", escaped(name), style, text)


def wkt_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A counter-clockwise closed ring."""
    pairs = ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.format_string("%.8f %.8f", a, b) for a, b in pairs]), F.lit("))"))


def escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def kml_document(placemarks: DataFrame, name: str, column: str = "placemark", order: str | None = None) -> DataFrame:
    parts = F.collect_list(F.struct(*([F.col(order).alias("o")] if order else []), F.col(column).alias("p")))
    joined = F.array_join(F.transform(F.array_sort(parts), lambda p: p["p"]), "")
    return placemarks.agg(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{name}</name>'), joined, F.lit("</Document></kml>")).alias("document"))


def html_card(title: Column, image: Column, links: Column) -> Column:
    """A review card with verdict buttons; ``image`` is base64 PNG text, ``links`` an array of name and url structs."""
    anchors = F.array_join(F.transform(links, lambda a: F.format_string('<a href="%s">%s</a>', escaped(a["url"]), escaped(a["name"]))), " ")
    buttons = "".join(f'<button data-verdict="{v}">{v}</button>' for v in ("palm", "not_palm", "unsure"))
    return F.concat(F.lit('<div class="card"><h3>'), escaped(title), F.lit('</h3><img src="data:image/png;base64,'), image, F.lit('"/>'), anchors, F.lit(buttons + "</div>"))


def page_links(x: Column, y: Column, lon: Column, lat: Column) -> Column:
    """Street, satellite and national map links of a place."""
    link = lambda name, pattern, *args: F.struct(F.lit(name).alias("name"), F.format_string(pattern, *args).alias("url"))
    return F.array(
        link("street", "https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=%.6f,%.6f", lat, lon),
        link("satellite", "https://www.google.com/maps/@%.6f,%.6f,60m/data=!3m1!1e3", lat, lon),
        link("map", "https://map.geo.admin.ch/?E=%.1f&N=%.1f&zoom=12&bgLayer=ch.swisstopo.swissimage", x, y),
    )


def write_document(document: DataFrame, path: str) -> None:
    """Write the one row's text to ``path`` on the driver, by a temporary name and a rename."""
    text = document.first()[0]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, path)


def write_scored(rows: DataFrame, path: str, score: str = "prob") -> None:
    """Scored rows, best first, replacing the former result at once (Spark's committer renames on success)."""
    rows.orderBy(F.desc(score)).write.mode("overwrite").parquet(path)


def write_scored_geojson(rows: DataFrame, path: str, score: str = "predicted_prob") -> int:
    """Scored rows (x, y, properties) as one GeoJSON file on a mounted folder, the best first; returns their number.

    Tasks write sorted lines into a folder beside ``path``; the driver strings them together part by part, holding one line
    at a time, under a temporary name that then replaces ``path``: a reader finds the old file or the new, never a half.
    """
    feature = point_feature(F.col("x"), F.col("y"), F.struct(*rows.columns), digits=3)
    name, target = uuid.uuid4().hex, os.path.abspath(path)
    parts, temporary = f"{target}.{name}.parts", f"{target}.{name}"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    rows.orderBy(F.desc(score), "x", "y").select(feature.alias("value")).write.text(f"file://{parts}")
    n = 0
    try:
        with open(temporary, "w", encoding="utf-8") as out:
            out.write(f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"{CRS_NAME}"}}}},"features":[')
            for part in sorted(p for p in os.listdir(parts) if p.startswith("part-")):
                with open(os.path.join(parts, part), encoding="utf-8") as lines:
                    for line in lines:
                        out.write(("," if n else "") + "\n" + line.rstrip("\n"))
                        n += 1
            out.write("\n]}\n")
        os.replace(temporary, target)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
    return n


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_labels(rows: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Append to a label store.  With ``key``, rows that are there already are left out, so a repeated merge adds nothing."""
    spark = rows.sparkSession
    if key:
        try:
            rows = rows.join(spark.read.parquet(path).select(*key).distinct(), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    rows.write.mode("append").parquet(path)


def write_by_cell(rows: DataFrame, path: str, cell: str = "cell") -> None:
    rows.repartition(cell).write.mode("overwrite").partitionBy(cell).parquet(path)


def answer_key(rows: DataFrame, path: str, *columns: str) -> None:
    rows.select(F.concat_ws("\t", *columns).alias("value")).coalesce(1).write.mode("overwrite").text(path)
