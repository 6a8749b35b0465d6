"""Vector and tabular inputs as DataFrames: GeoJSON, KML, occurrences, services' recorded pages, CSV."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselon.sources.vector_files import vector_points

VERDICTS = T.StructType([T.StructField(n, t) for n, t in (("index", T.IntegerType()), ("tile", T.StringType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("corrected_x", T.DoubleType()), ("corrected_y", T.DoubleType()), ("predicted_prob", T.DoubleType()), ("verdict", T.StringType()))])


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y and the file's own properties."""
    features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    place = F.col("f.geometry.coordinates")
    kept = [c for c in features.select("f.properties.*").columns if c.lower() not in ("x", "y")] if "properties" in features.schema["f"].dataType.names else []
    return features.select(place[0].cast("double").alias("x"), place[1].cast("double").alias("y"), *[F.col(f"f.properties.`{c}`").alias(c) for c in kept])


def ragged_points(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several label files whose properties differ; ``file_order`` tells which came first."""
    out = None
    for i, path in enumerate(paths):
        layer = geojson_points(spark, path).withColumn("file_order", F.lit(i))
        out = layer if out is None else out.unionByName(layer, allowMissingColumns=True)
    return out


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON with longitude and latitude under any usual name, in any case, or points of a GeoPackage or Shapefile.

    Rows without a place are dropped.
    """
    if path.lower().endswith((".gpkg", ".shp")):
        return vector_points(spark, path).withColumnsRenamed({"x": "lon", "y": "lat"})
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.lower().endswith(".csv") else spark.read.option("multiLine", True).json(path)
    lower = {c.lower(): c for c in df.columns}
    find = lambda names: next((lower[n] for n in names if n in lower), None)
    lon, lat = find(("lon", "longitude", "decimallongitude", "lng", "x")), find(("lat", "latitude", "decimallatitude", "y"))
    if lon is None or lat is None:
        raise ValueError(f"no longitude or latitude among {df.columns}")
    return df.withColumns({"lon": F.col(lon).cast("double"), "lat": F.col(lat).cast("double")}).dropna(subset=["lon", "lat"])


def occurrence_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded pages of an occurrence search: results up to the page that ends the records."""
    pages = spark.read.option("multiLine", True).json(path)
    last = pages.filter("endOfRecords").agg(F.min("offset").alias("last"))
    kept = pages.crossJoin(F.broadcast(last)).filter("last is null or offset <= last")  # one row
    r = kept.select(F.explode("results").alias("r"))
    out = r.select(F.col("r.key").cast("string").alias("gbifID"), "r.species", F.col("r.year").cast("int").alias("year"), F.col("r.coordinateUncertaintyInMeters").cast("double").alias("coordUncertainty_m"), F.col("r.basisOfRecord").alias("basisOfRecord"), F.col("r.decimalLongitude").cast("double").alias("lon"), F.col("r.decimalLatitude").cast("double").alias("lat"))
    return out.dropna(subset=["lon", "lat"])


def catalogue_items(spark: SparkSession, path: str) -> DataFrame:
    """Features of recorded catalogue pages (each page links to the next; all are read): year and assets."""
    asset = "map<string,struct<href:string>>"
    schema = f"features array<struct<id:string,properties:struct<datetime:string>,assets:{asset}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.id", F.substring("f.properties.datetime", 1, 4).alias("year"), "f.assets")


def assets_by_year(items: DataFrame, tag: str) -> DataFrame:
    """Sorted links of .tif assets whose name holds ``tag``, by year."""
    links = items.select("year", F.explode(F.map_entries("assets")).alias("a")).select("year", F.col("a.key").alias("name"), F.col("a.value.href").alias("href"))
    return links.filter(F.col("name").contains(tag) & F.col("href").endswith(".tif")).groupBy("year").agg(F.array_sort(F.collect_list("href")).alias("hrefs"))


def roads(spark: SparkSession, path: str) -> DataFrame:
    """Recorded highway ways as arrays of lon and lat; ways of fewer than two points are dropped."""
    schema = "elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    return e.filter((F.col("type") == "way") & F.col("tags").getItem("highway").isNotNull() & (F.size("geometry") >= 2)).select("id", F.col("geometry").alias("points"))


def kml_points(spark: SparkSession, paths: list[str]) -> DataFrame:
    """folder (innermost, null at the root), name, lon and lat of each point placemark."""
    import xml.etree.ElementTree as ET

    def walk(node, folder, out):
        tag = node.tag.rpartition("}")[2]
        if tag == "Placemark":
            text = {c.tag.rpartition("}")[2]: c for c in node.iter()}
            if "Point" in text and "coordinates" in text:
                lon, lat = text["coordinates"].text.strip().split(",")[:2]
                out.append((folder, (text["name"].text or "").strip() if "name" in text else None, float(lon), float(lat)))
            return
        if tag == "Folder":
            folder = next(((c.text or "").strip() for c in node if c.tag.rpartition("}")[2] == "name"), folder)
        for child in node:
            walk(child, folder, out)

    def parse(pdf):
        import pandas as pd

        for batch in pdf:
            rows: list = []
            for text in batch["content"]:
                walk(ET.fromstring(bytes(text)), None, rows)
            yield pd.DataFrame(rows, columns=["folder", "name", "lon", "lat"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(parse, "folder string, name string, lon double, lat double")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """date_dir and cell of a headerless list; blank lines and lines without a comma are skipped."""
    parts = F.split(F.trim("value"), ",", 2)
    return spark.read.text(path).filter(F.col("value").contains(",")).select(F.trim(parts[0]).alias("date_dir"), F.trim(parts[1]).alias("cell"))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Review verdicts; all columns must be there."""
    head = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in VERDICTS if f.name not in head]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return spark.read.option("header", True).schema(T.StructType([next(f for f in VERDICTS if f.name == c) if c in VERDICTS.names else T.StructField(c, T.StringType()) for c in head])).csv(path)


# Columns of a feature table that no model sees.
NOT_FEATURES = ("point_id", "label", "fold_tile", "x", "y", "n_dates_covered")


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """A feature CSV, checked: features without NaN, labels 0 or 1, a fold in each row."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    bad = [F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")) for c in feature_columns(df)]
    wrong = ~F.col("label").isin(0, 1) | F.col("label").isNull() | F.col("fold_tile").isNull()
    for b in bad:
        wrong = wrong | b
    if df.filter(wrong).limit(1).count():
        raise ValueError(f"{path} has rows with missing features, labels or folds")
    return df


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def ablated(df: DataFrame, drop_small_window: bool = False, drop_shape: bool = False) -> DataFrame:
    """Feature sets without canopy statistics of the smallest window, or without shape features."""
    small = [c for c in df.columns if c.startswith("chm_") and c.endswith("_r1.0") and "clipped" not in c]
    shape = [c for c in df.columns if any(s in c for s in ("peak_ratio", "skew", "kurtosis", "roughness", "asymmetry"))]
    return df.drop(*(small if drop_small_window else []), *(shape if drop_shape else []))


def delivery(tiles: DataFrame) -> DataFrame:
    """Summary of a delivery of tiles: shapes, missing placement, dates and extent."""
    x1, y1 = F.col("x0") + F.col("width") * F.col("res"), F.col("y0") - F.col("height") * F.col("res")
    return tiles.groupBy("date").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("epsg").isNull()).alias("without_crs"), F.min("x0").alias("left"), F.min(y1).alias("bottom"), F.max(x1).alias("right"), F.max("y0").alias("top"), F.collect_set(F.concat_ws("x", "width", "height")).alias("shapes"))


@dataclass(frozen=True)
class AreaConfig:
    """An area of interest and its parameters."""

    name: str
    crs: str = "EPSG:2056"
    bbox: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    tile_size_px: int = 1024
    overlap_px: int = 128
    res_m: float = 0.1
    paths: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.crs != "EPSG:2056":
            raise ValueError("areas are given in EPSG:2056")
