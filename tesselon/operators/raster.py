"""Whole-tile operators: metadata, resampling, rasterising, stacks and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions import spectral


def from_array(tiles: DataFrame, key: str, column: str, width: int, name: str = "v") -> DataFrame:
    """Explode an array of samples in row-major order to (cell, row, col, value)."""
    out = tiles.select(F.col(key).alias("cell"), F.posexplode(column).alias("_p", "_v"))
    return out.select("cell", F.floor(F.col("_p") / width).cast("int").alias("row"), (F.col("_p") % width).cast("int").alias("col"), F.col("_v").cast("double").alias(name))


def to_array(px: DataFrame, value: str = "v", key: str = "cell") -> DataFrame:
    """Back to one row-major array a tile."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("v"))))
    return px.groupBy(key).agg(F.transform(ordered, lambda p: p["v"]).alias("values"))


def metadata(px: DataFrame, value: str = "v") -> DataFrame:
    """Shape, extremes, median and valid count of every tile."""
    return px.groupBy("cell").agg(
        (F.max("row") + 1).alias("height"),
        (F.max("col") + 1).alias("width"),
        F.min(value).alias("lo"),
        F.expr(f"percentile({value}, 0.5)").alias("median"),
        F.max(value).alias("hi"),
        F.count_if(F.col(value) != 0).alias("valid"),
    )


def empty_tiles(px: DataFrame, value: str = "v") -> DataFrame:
    """Tiles that hold data: their maximum isn't zero."""
    return px.groupBy("cell").agg(F.max(value).alias("hi")).filter("hi > 0")


def mostly_nodata(px: DataFrame, *bands: str) -> DataFrame:
    """Share of no-data pixels of each tile, and whether it is more than half."""
    share = F.avg((~spectral.is_valid(*[F.col(b) for b in bands])).cast("int"))
    return px.groupBy("cell").agg(share.alias("share")).withColumn("mostly", F.col("share") > 0.5)


def channel_stats(px: DataFrame, *bands: str) -> DataFrame:
    """One row a band: mean and population standard deviation; partial states are merged by the aggregation."""
    aggregates = [f(b).alias(f"{n}_{b}") for b in bands for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    row = px.agg(*aggregates)
    return row.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"mean_{b}").alias("mean"), F.col(f"std_{b}").alias("std")) for b in bands])))


def normalised(px: DataFrame, *bands: str) -> DataFrame:
    """Bands less their mean over their deviation; the statistics are one row, broadcast."""
    stats = px.agg(*[f(b).alias(f"_{n}_{b}") for b in bands for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = px.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*[c for c in px.columns if c not in bands], *[spectral.normalise(F.col(b), F.col(f"_m_{b}"), F.col(f"_s_{b}")).alias(b) for b in bands])


def contrast_stretch(px: DataFrame, value: str = "v", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds stretched: the value between the tile's two percentiles, clipped to [0, 1]."""
    bounds = px.groupBy("cell").agg(F.expr(f"percentile({value}, array({low}, {high}))").alias("_b"))
    return px.join(bounds, "cell").withColumn("stretched", spectral.stretch(F.col(value), F.col("_b")[0], F.col("_b")[1])).drop("_b")


def resample_bilinear(px: DataFrame, factor: int, height: int, width: int, value: str = "v") -> DataFrame:
    """Tiles at ``factor`` times the resolution; target centres between source centres, edges held.

    Each source pixel is sent to the targets it weighs in (a generator of bounded size), which sum.
    """
    offsets = F.sequence(F.lit(0), F.lit(factor - 1))
    out = px
    for axis, n, other in (("row", height, "col"), ("col", width, "row")):
        # Target t of n * factor lies at (t + 0.5) / factor - 0.5 of the source.
        targets = F.explode(F.flatten(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.transform(offsets, lambda o: (F.col(axis) + k) * factor + o))))
        sent = out.select("cell", axis, other, F.col(value).alias("_v"), targets.alias("_t")).filter(F.col("_t").between(0, n * factor - 1))
        place = F.least(F.greatest((F.col("_t") + 0.5) / factor - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
        weight = F.greatest(1 - F.abs(place - F.col(axis)), F.lit(0.0))
        out = sent.filter(weight > 0).groupBy("cell", F.col("_t").cast("int").alias(axis), other).agg(F.sum(weight * F.col("_v")).alias(value))
    return out.select("cell", "row", "col", value)


def upsample_nearest(px: DataFrame, k: int, value: str = "v") -> DataFrame:
    """Every pixel repeated k by k times."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    rows = px.withColumn("_a", F.explode(steps)).withColumn("_b", F.explode(steps))
    return rows.select("cell", (F.col("row") * k + F.col("_a")).alias("row"), (F.col("col") * k + F.col("_b")).alias("col"), value)


def centre_crop(px: DataFrame, size: int, height: int, width: int) -> DataFrame:
    top, left = (height - size) // 2, (width - size) // 2
    inside = F.col("row").between(top, top + size - 1) & F.col("col").between(left, left + size - 1)
    return px.filter(inside).withColumns({"row": F.col("row") - top, "col": F.col("col") - left})


def crops(points: DataFrame, px: DataFrame, half: int, height: int, width: int, clamp: bool = True, value: str = "v", key: str = "id") -> DataFrame:
    """Square crops of side 2 * half + 1 around points (cell, row, col): key, i, j and the value.

    With ``clamp`` a crop near the edge is moved inside; without, points nearer than ``half`` to the edge have none.
    Points send their pixels' places, so this is one equi-join.
    """
    size = 2 * half + 1
    if clamp:
        top, left = (F.least(F.greatest(F.col(c) - half, F.lit(0)), F.lit(n - size)) for c, n in (("row", height), ("col", width)))
    else:
        points = points.filter(F.col("row").between(half, height - 1 - half) & F.col("col").between(half, width - 1 - half))
        top, left = F.col("row") - half, F.col("col") - half
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    sent = points.select(key, "cell", top.alias("_t"), left.alias("_l"), F.explode(steps).alias("i")).withColumn("j", F.explode(steps))
    return sent.select(key, "cell", "i", "j", (F.col("_t") + F.col("i")).alias("row"), (F.col("_l") + F.col("j")).alias("col")).join(px.select("cell", "row", "col", value), ["cell", "row", "col"]).select(key, "i", "j", value)


def crops_with_data(crop: DataFrame, value: str = "v", key: str = "id") -> DataFrame:
    """Crops of which at most half the pixels are zero."""
    return crop.join(crop.groupBy(key).agg(F.avg((F.col(value) == 0).cast("int")).alias("_z")).filter("_z <= 0.5").select(key), key, "left_semi")


def rasterise_disks(points: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Distinct pixels (cell, row, col) within less than ``radius`` of a point's pixel."""
    offsets = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr * dr + dc * dc < radius * radius]
    table = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    sent = points.select("cell", "row", "col", F.inline(table)).select("cell", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    return sent.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def point_counts(points: DataFrame) -> DataFrame:
    """Points a pixel: co-located ones add up."""
    return points.groupBy("cell", "row", "col").agg(F.count(F.lit(1)).cast("double").alias("v"))


def stack(surface: DataFrame, terrain: DataFrame, rgb: DataFrame) -> DataFrame:
    """R, G, B and canopy height on one grid: an inner join on (cell, row, col)."""
    on = ["cell", "row", "col"]
    return rgb.join(surface, on).join(terrain, on).select(*on, "r", "g", "b", spectral.canopy_height(F.col("dsm"), F.col("dtm")).alias("chm"))


def mosaic(sources: DataFrame, order: Column, value: str = "v") -> DataFrame:
    """First source wins: of each pixel, the valid value of least ``order``."""
    first = F.min_by(F.col(value), order)
    return sources.filter(F.col(value).isNotNull()).groupBy("cell", "row", "col").agg(first.alias(value))


def cut_tiles(px: DataFrame, tile: int, overlap: int, value: str = "v", most: int | None = None) -> DataFrame:
    """Overlapping tiles of an area's pixels (row and col from its upper left): r, c, row, col and the value.

    A pixel finds its tiles by arithmetic, so nothing is joined to place it.  Tiles without data (their maximum is 0) are
    left out; of the others, the first ``most`` in order of r and c are kept.  The last tiles may be truncated.
    """
    stride = tile - overlap
    own = lambda g: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(g) - tile + 1) / stride).cast("int")), F.floor(F.col(g) / stride).cast("int")))
    sent = px.select("row", "col", value, own("row").alias("r")).withColumn("c", own("col"))
    out = sent.select("r", "c", (F.col("row") - F.col("r") * stride).alias("row"), (F.col("col") - F.col("c") * stride).alias("col"), value)
    held = out.groupBy("r", "c").agg(F.max(value).alias("_hi")).filter("_hi <> 0").select("r", "c")
    return out.join(held if most is None else held.orderBy("r", "c").limit(most), ["r", "c"], "left_semi")


def backdrop(rgb: DataFrame, surface: DataFrame, bands: list[str]) -> DataFrame:
    """A tile's bands, stretched between the 2nd and 98th percentile of all of them, beside a surface's columns.

    Tiles and surfaces of one cell that differ in shape raise an error.
    """
    on = ["cell", "row", "col"]
    every = F.array(*bands)
    side = lambda df, n: df.groupBy("cell").agg(F.max("row").alias(f"_h{n}"), F.max("col").alias(f"_w{n}"))
    bounds = rgb.select("cell", F.explode(every).alias("_v")).groupBy("cell").agg(F.expr("percentile(_v, array(0.02, 0.98))").alias("_b"))
    shapes = side(rgb, 0).join(side(surface, 1), "cell").join(bounds, "cell")
    same = (F.col("_h0") == F.col("_h1")) & (F.col("_w0") == F.col("_w1"))
    checked = shapes.select("cell", F.when(same, F.col("_b")).otherwise(F.raise_error(F.concat(F.lit("surface and tile differ in shape: "), "cell"))).alias("_b"))
    out = rgb.join(surface, on).join(checked, "cell")
    return out.withColumns({b: spectral.stretch(F.col(b), F.col("_b")[0], F.col("_b")[1]) for b in bands}).drop("_b")


def aligned_to(reference: DataFrame, px: DataFrame, value: str = "v") -> DataFrame:
    """``px`` on exactly the reference's pixels, zero where it has none."""
    on = ["cell", "row", "col"]
    return reference.select(*on).join(px.select(*on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def sharpness(px: DataFrame, value: str = "v") -> DataFrame:
    """Variance of the Laplacian of every tile."""
    from tesselon.operators.focal import laplacian

    return laplacian(px, value).groupBy("cell").agg(F.var_pop("lap").alias("sharpness"))


def newest(px: DataFrame, by: list[str], date: str, *bands: str) -> DataFrame:
    """Of each location the newest date whose pixel isn't no-data."""
    valid = px.filter(spectral.is_valid(*[F.col(b) for b in bands]))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(date)))
    return valid.withColumn("_n", rank).filter("_n = 1").drop("_n")
