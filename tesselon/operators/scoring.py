"""Scoring a grid of locations and whole tiles over all dates: coverage, features, and ranked rows or rasters.

``tiles`` has a row for each cell and date: cell, date, x0, y0, x1, y1 (left, bottom, right, top), res, height, width.
``px`` has their pixels: cell, date, row, col and bands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators import models, spatial, temporal


def grid_locations(tiles: DataFrame, spacing: float, reviewed: DataFrame | None = None, distance: float = 0.0) -> DataFrame:
    """id, x and y of a grid over all tiles: places strictly inside a tile and no nearer than ``distance`` to a reviewed point."""
    box = tiles.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("size")).first()
    if box["x0"] is None:
        return tiles.sparkSession.createDataFrame([], "id long, x double, y double")
    grid = spatial.grid_points(tiles.sparkSession, box["x0"], box["y0"], box["x1"], box["y1"], spacing)
    footprints = tiles.select("x0", "y0", "x1", "y1").distinct()
    covered = spatial.covering(grid, footprints, box["size"]).select("id", "x", "y").distinct()
    return covered if reviewed is None else spatial.not_within(covered, reviewed, distance)


def sightings(locations: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """One row for each location and tile that covers it, with the pixel it lies on."""
    seen = spatial.covering(locations, tiles, size)
    row, col = F.floor((F.col("y1") - F.col("y")) / F.col("res")), F.floor((F.col("x") - F.col("x0")) / F.col("res"))
    inside = lambda i, n: F.least(F.greatest(i, F.lit(0)), F.col(n) - 1).cast("int")
    return seen.select(*locations.columns, "cell", "date", inside(row, "height").alias("row"), inside(col, "width").alias("col"))


def newest_with_stability(rows: DataFrame, by: Sequence[str], values: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each place the row that comes first in ``order``, with the deviation and range of ``values`` over all of its rows."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return temporal.with_stability(rows, by, values).withColumn("_n", first).filter("_n = 1").drop("_n")


def location_features(locations: DataFrame, tiles: DataFrame, windows: DataFrame, valid: Column, values: Sequence[str], size: float) -> DataFrame:
    """Features of each location: those of its newest date with data, and ``values``' stability over all its dates.

    ``windows`` are the pixels with their features.  Locations without data on any date have no row.
    """
    seen = sightings(locations, tiles, size).join(windows.filter(valid), ["cell", "date", "row", "col"])
    return newest_with_stability(seen, ["id"], values, [F.desc("date"), F.asc("cell")]).drop("row", "col")


def scored_grid(model: PipelineModel, rows: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """x, y, tile and predicted_prob of each location, and the ``prior`` results, the best first."""
    fresh = models.score(model, rows).select("x", "y", F.col("cell").alias("tile"), F.col("prob").alias("predicted_prob"))
    every = fresh if prior is None else prior.select(*fresh.columns).unionByName(fresh)
    return every.orderBy(F.desc("predicted_prob"), "x", "y")


def dense_stack(windows: DataFrame, valid: Column, values: Sequence[str]) -> DataFrame:
    """Features of each pixel of a cell: those of its newest valid date, and ``values``' stability over the valid ones."""
    return newest_with_stability(windows.filter(valid), ["cell", "row", "col"], values, [F.desc("date")])


def dense_surface(model: PipelineModel, stack: DataFrame, px: DataFrame) -> DataFrame:
    """cell, row, col and prob of every pixel of ``px``; null where no date is valid."""
    on = ["cell", "row", "col"]
    return px.select(*on).distinct().join(models.score(model, stack).select(*on, "prob"), on, "left")


def rasters(surface: DataFrame, tiles: DataFrame, value: str = "prob", suffix: str = "_prob.tif", epsg: int = 2056) -> DataFrame:
    """One row a cell, as the GeoTIFF sink takes it: one band, NaN where ``value`` is null.  A cell's dates share its placement."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "col", F.coalesce(F.col(value).cast("float"), F.lit(float("nan")).cast("float")).alias("v"))))
    bands = surface.groupBy("cell").agg(F.array(F.transform(ordered, lambda p: p["v"])).alias("bands"))
    placed = tiles.groupBy("cell").agg(F.first("height").cast("int").alias("height"), F.first("width").cast("int").alias("width"), F.first("x0").alias("x0"), F.first("y1").alias("y0"), F.first("res").alias("res"))
    return bands.join(placed, "cell").select(F.concat("cell", F.lit(suffix)).alias("path"), "cell", F.lit(None).cast("string").alias("date"), "height", "width", "x0", "y0", "res", F.lit(epsg).alias("epsg"), "bands")
