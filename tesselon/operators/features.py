"""The feature table: every window feature of a band at every pixel, or at points only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators import focal


def window_features(px: DataFrame, radii: Sequence[int], value: str = "v", prefix: str = "v", shape: bool = True) -> DataFrame:
    """cell, row, col, the value, and for each radius its statistics, shape features and clipping, and the contrasts.

    Every window adds its columns to the rows that it has, so only the sectors, which are no windows, are joined.
    """
    on = ["cell", "row", "col"]
    base = px.select(*on, F.col(value).alias(prefix))
    out = band_windows(base, [prefix], radii)
    for r in radii if shape else ():
        mean = F.col(f"{prefix}_mean_{r}")
        out = out.withColumn(f"{prefix}_peak_ratio_{r}", F.when(mean > 0, F.col(f"{prefix}_max_{r}") / mean).otherwise(0.0))
        out = focal.moments(out, r, prefix).withColumnsRenamed({"skew": f"{prefix}_skew_{r}", "kurt": f"{prefix}_kurtosis_{r}"})
        out = focal.roughness(out, r, prefix).withColumnRenamed("rough", f"{prefix}_local_roughness_{r}")
        out = focal.clipped(out, r).withColumnRenamed("clipped", f"{prefix}_window_clipped_{r}")
        out = out.join(focal.radial_asymmetry(base, r, value=prefix).withColumnRenamed("asymmetry", f"{prefix}_asymmetry_{r}"), on)
    return out.drop(prefix)


def band_windows(px: DataFrame, bands: Sequence[str], radii: Sequence[int], cell: Sequence[str] = ("cell",)) -> DataFrame:
    """Mean, deviation, maximum and minimum of several bands over several radii, and the contrasts, by two shuffles in all.

    All frames along rows share one partitioning, and so do those along columns.  Sums of squares are taken of the bands as
    they are, which suits indices and heights in metres.
    """
    across, down = (Window.partitionBy(*cell, a).orderBy(b) for a, b in (("row", "col"), ("col", "row")))
    sums = {"n": F.lit(1.0)} | {f"{b}_s1": F.col(b) for b in bands} | {f"{b}_s2": F.col(b) * F.col(b) for b in bands}
    parts = [(n, F.sum, e) for n, e in sums.items()] + [(f"{b}_{n}", f, F.col(b)) for b in bands for n, f in (("max", F.max), ("min", F.min))]
    out = px.withColumns({f"_i_{n}": e for n, _, e in parts})
    out = out.withColumns({f"_h{r}_{n}": f(f"_i_{n}").over(across.rangeBetween(-r, r)) for r in radii for n, f, _ in parts})
    out = out.withColumns({f"_f{r}_{n}": f(f"_h{r}_{n}").over(down.rangeBetween(-r, r)) for r in radii for n, f, _ in parts})
    found = {f"{b}_point": F.col(b) for b in bands}
    for r in radii:
        n = F.col(f"_f{r}_n")
        for b in bands:
            mean = F.col(f"_f{r}_{b}_s1") / n
            std = F.sqrt(F.greatest(F.col(f"_f{r}_{b}_s2") / n - mean * mean, F.lit(0.0)))
            found |= {f"{b}_mean_{r}": mean, f"{b}_std_{r}": std, f"{b}_max_{r}": F.col(f"_f{r}_{b}_max"), f"{b}_min_{r}": F.col(f"_f{r}_{b}_min")}
    found |= {f"{b}_contrast": F.col(b) - F.col(f"_f{max(radii)}_{b}_s1") / F.col(f"_f{max(radii)}_n") for b in bands}
    return out.select(*px.columns, *[e.alias(k) for k, e in found.items()])


def at_points(features: DataFrame, points: DataFrame) -> DataFrame:
    """Features of the pixels (cell, row, col) that points lie on."""
    return points.join(features, ["cell", "row", "col"])


def point_table(px: DataFrame, points: DataFrame, radii: Sequence[int], shape: bool = True) -> DataFrame:
    """Points (cell, row, col) with the features of their pixels; only tiles that hold points are worked on."""
    held = px.join(points.select("cell").distinct(), "cell", "left_semi")
    return at_points(window_features(held, radii, shape=shape), points)
