"""Moving-window statistics on the pixel relation (cell, row, col, value).

Windows are squares of side 2 R + 1, truncated at the tile's edge.  A square window is separable, so
sums, counts, minima and maxima take two one-dimensional range frames, along rows and then along
columns: two shuffles on (cell, row) and (cell, col) whatever R is, and no neighbour join.
Moments derive from sums of powers; values are shifted by the tile's mean first, so that large
offsets don't cost precision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-6


def _frames(cell: str, radius: int):
    across = Window.partitionBy(cell, "row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy(cell, "col").orderBy("row").rangeBetween(-radius, radius)
    return across, down


def separable(px: DataFrame, radius: int, inputs: dict[str, tuple[str, Column]], cell: str = "cell") -> DataFrame:
    """Adds one column for each of ``inputs``: name -> (sum, min or max; expression)."""
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    across, down = _frames(cell, radius)
    named = px.withColumns({f"_i_{k}": e for k, (_, e) in inputs.items()})
    half = named.withColumns({f"_h_{k}": how[f](f"_i_{k}").over(across) for k, (f, _) in inputs.items()})
    full = half.withColumns({k: how[f](f"_h_{k}").over(down) for k, (f, _) in inputs.items()})
    return full.drop(*[f"_{p}_{k}" for p in "ih" for k in inputs])


def mean_std(px: DataFrame, radius: int, value: str = "v", cell: str = "cell") -> DataFrame:
    """Adds n, mean and std (population)."""
    v = F.col(value)
    sums = separable(px, radius, {"n": ("sum", F.lit(1.0)), "_s1": ("sum", v), "_s2": ("sum", v * v)}, cell)
    mean = F.col("_s1") / F.col("n")
    return sums.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("_s2") / F.col("n") - mean * mean, F.lit(0.0)))).drop("_s1", "_s2")


def minmax(px: DataFrame, radius: int, value: str = "v", cell: str = "cell") -> DataFrame:
    return separable(px, radius, {"lo": ("min", F.col(value)), "hi": ("max", F.col(value))}, cell)


def moments(px: DataFrame, radius: int, value: str = "v", cell: str = "cell") -> DataFrame:
    """Adds skew and kurt (excess), both of the population; 0 where the window is flat."""
    px = px.withColumn("_m", F.avg(value).over(Window.partitionBy(cell)))
    d = F.col(value) - F.col("_m")
    powers = {f"_p{k}": ("sum", F.pow(d, F.lit(float(k)))) for k in range(1, 5)}
    out = separable(px, radius, {"_n": ("sum", F.lit(1.0)), **powers}, cell)
    a, b, c, e = (F.col(f"_p{k}") / F.col("_n") for k in range(1, 5))
    var = b - a * a
    third = c - 3 * a * b + 2 * a * a * a
    fourth = e - 4 * a * c + 6 * a * a * b - 3 * a * a * a * a
    out = out.withColumns({"_var": var, "_third": third, "_fourth": fourth})
    flat = F.col("_var") <= FLAT
    skew = F.when(flat, 0.0).otherwise(F.col("_third") / F.pow("_var", F.lit(1.5)))
    kurt = F.when(flat, 0.0).otherwise(F.col("_fourth") / (F.col("_var") * F.col("_var")) - 3)
    return out.withColumns({"skew": skew, "kurt": kurt}).drop("_m", "_n", "_var", "_third", "_fourth", *powers)


def peak_ratio(px: DataFrame, radius: int, value: str = "v", cell: str = "cell") -> DataFrame:
    """Adds ratio: window maximum over window mean, 0 where the mean isn't positive."""
    v = F.col(value)
    out = separable(px, radius, {"_n": ("sum", F.lit(1.0)), "_s": ("sum", v), "_x": ("max", v)}, cell)
    mean = F.col("_s") / F.col("_n")
    return out.withColumn("ratio", F.when(mean > 0, F.col("_x") / mean).otherwise(0.0)).drop("_n", "_s", "_x")


def laplacian(px: DataFrame, value: str = "v", cell: str = "cell") -> DataFrame:
    """Adds lap: sum of the four neighbours less four times the value; an edge repeats itself."""
    v = F.col(value)
    rows, cols = Window.partitionBy(cell, "col").orderBy("row"), Window.partitionBy(cell, "row").orderBy("col")
    around = [F.coalesce(f(value).over(w), v) for w in (rows, cols) for f in (F.lag, F.lead)]
    return px.withColumn("lap", around[0] + around[1] + around[2] + around[3] - 4 * v)


def roughness(px: DataFrame, radius: int, value: str = "v", cell: str = "cell") -> DataFrame:
    """Adds rough: window standard deviation of the Laplacian."""
    return mean_std(laplacian(px, value, cell), radius, "lap", cell).withColumnRenamed("std", "rough").drop("mean", "n", "lap")


def clipped(px: DataFrame, radius: int, cell: str = "cell") -> DataFrame:
    """Adds clipped: 1 where the window leaves the tile."""
    whole = Window.partitionBy(cell)
    edge = (F.col("row") < radius) | (F.col("col") < radius) | (F.col("row") > F.max("row").over(whole) - radius) | (F.col("col") > F.max("col").over(whole) - radius)
    return px.withColumn("clipped", edge.cast("int"))


def sector_offsets(radius: int, sectors: int = 8) -> list[tuple[int, int, int]]:
    """(row offset, column offset, sector) in the disc; the centre belongs to none."""
    import math

    out = []
    for dr in range(-radius, radius + 1):
        for dc in range(-radius, radius + 1):
            if (dr or dc) and dr * dr + dc * dc <= radius * radius:
                angle = math.atan2(dr, dc) % (2 * math.pi)
                out.append((dr, dc, min(int(angle / (2 * math.pi / sectors)), sectors - 1)))
    return out


def neighbours(px: DataFrame, offsets: Sequence[tuple], columns: Sequence[str], value: str = "v", cell: str = "cell") -> DataFrame:
    """Pixels joined with those at each offset: (cell, row, col, <offset columns>, nv).

    Each pixel's value is sent to the windows that hold it, and meets them in one aggregation on
    (cell, row, col): a generator and one shuffle, no self-join.
    """
    table = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(o, columns, strict=True)]) for o in offsets])
    sent = px.select(cell, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("nv"), F.inline(table))
    extra = [c for c in columns if c not in ("dr", "dc")]
    return sent.select(cell, (F.col("_r") - F.col("dr")).alias("row"), (F.col("_c") - F.col("dc")).alias("col"), *extra, "nv")


def radial_asymmetry(px: DataFrame, radius: int, sectors: int = 8, value: str = "v", cell: str = "cell") -> DataFrame:
    """Population variance of the sector means around each pixel; 0 with fewer than two sectors."""
    sent = neighbours(px, sector_offsets(radius, sectors), ("dr", "dc", "sector"), value, cell)
    means = sent.groupBy(cell, "row", "col").agg(
        *[F.avg(F.when(F.col("sector") == s, F.col("nv"))).alias(f"_w{s}") for s in range(sectors)],
    )
    kept = F.filter(F.array(*[F.col(f"_w{s}") for s in range(sectors)]), lambda x: x.isNotNull())
    n = F.size("_k")
    mean = F.aggregate("_k", F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate("_k", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    out = means.withColumn("_k", kept).withColumn("_mean", mean).withColumn("asymmetry", F.when(n < 2, 0.0).otherwise(var))
    return px.select(cell, "row", "col").join(out.select(cell, "row", "col", "asymmetry"), [cell, "row", "col"], "left").withColumn("asymmetry", F.coalesce("asymmetry", F.lit(0.0)))


def masked_ratio(px: DataFrame, radius: int, value: str, mask: Column, least: float = 0.1, cell: str = "cell") -> DataFrame:
    """Adds ratio: value over the mean of masked window pixels; 1 where less than ``least`` of the window is masked."""
    m = F.when(mask, 1.0).otherwise(0.0)
    out = separable(px, radius, {"_n": ("sum", F.lit(1.0)), "_m": ("sum", m), "_s": ("sum", m * F.col(value))}, cell)
    ratio = F.when(F.col("_m") / F.col("_n") < least, 1.0).otherwise(F.col(value) / (F.col("_s") / F.col("_m")))
    return out.withColumn("ratio", ratio).drop("_n", "_m", "_s")


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    import math

    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    total = sum(w)
    return [(d, x / total) for d, x in zip(range(-r, r + 1), w, strict=True)]


def _reflect(i: Column, n: int) -> Column:
    """Index in a signal that is mirrored, edge value repeated, beyond its ends."""
    j = F.pmod(i, F.lit(2 * n))
    return F.when(j < n, j).otherwise(2 * n - 1 - j)


def gaussian(px: DataFrame, sigma: float, height: int, width: int, value: str = "v", cell: str = "cell") -> DataFrame:
    """Gaussian blur of whole tiles with reflected edges, one axis after the other; returns cell, row, col, blur."""
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in gaussian_kernel(sigma)])
    for axis, n, other in (("row", height, "col"), ("col", width, "row")):
        # A source pixel s feeds the targets t with reflect(t + d) = s: those are t = s - d and its mirror images.
        sent = px.select(cell, "row", "col", F.col(value).alias("_v"), F.inline(kernel))
        images = [F.col(axis) + k * 2 * n - F.col("d") for k in (-1, 0, 1)] + [2 * n * k - 1 - F.col(axis) - F.col("d") for k in (0, 1)]
        spread = sent.withColumn("_t", F.explode(F.array(*images))).filter(F.col("_t").between(0, n - 1))
        px = spread.groupBy(cell, F.col("_t").alias(axis), other).agg(F.sum(F.col("w") * F.col("_v")).alias(value))
    return px.select(cell, "row", "col", F.col(value).alias("blur"))


def hillshade(px: DataFrame, azimuth: float = 315.0, altitude: float = 35.0, value: str = "v", cell: str = "cell") -> DataFrame:
    """Adds shade in [0, 1] from the gradient of ``value``."""
    import math

    rows, cols = Window.partitionBy(cell, "col").orderBy("row"), Window.partitionBy(cell, "row").orderBy("col")

    def slope(w) -> Column:
        before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)

    az, alt = math.radians(90 - azimuth), math.radians(altitude)
    light = (math.cos(az) * math.cos(alt), math.sin(az) * math.cos(alt), math.sin(alt))
    out = px.withColumns({"_dy": slope(rows), "_dx": slope(cols)})
    dot = (-F.col("_dx") * light[0] + F.col("_dy") * light[1] + light[2]) / F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + 1)
    return out.withColumn("shade", F.least(F.greatest((dot + 1) / 2, F.lit(0.0)), F.lit(1.0))).drop("_dx", "_dy")


def peaks(px: DataFrame, radius: int, threshold: float, value: str = "v", cell: str = "cell") -> DataFrame:
    """Pixels that equal their window's maximum and reach the threshold; ties are all kept; nulls are never peaks."""
    known = px.withColumn("_v", F.coalesce(F.col(value), F.lit(float("-inf"))))
    out = separable(known, radius, {"_hi": ("max", F.col("_v"))}, cell)
    return out.filter((F.col("_v") == F.col("_hi")) & (F.col("_v") >= threshold)).drop("_v", "_hi")


def kernel_stats(tiles: DataFrame, radius: int, height: int, width: int, key: str = "cell", column: str = "values") -> DataFrame:
    """Window mean, std, min and max of tiles that are one array a row, without exploding pixels.

    For large tiles: summed-area tables and running extremes over Arrow batches, no shuffle.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outs: list[list] = [[], [], [], []]
            for flat in batch.column(1):
                a = np.asarray(flat.values.to_numpy(zero_copy_only=False), np.float64).reshape(height, width)

                def box(x: np.ndarray) -> np.ndarray:
                    s = np.zeros((height + 1, width + 1))
                    s[1:, 1:] = x.cumsum(0).cumsum(1)
                    r, c = np.arange(height), np.arange(width)
                    r0, r1 = np.maximum(r - radius, 0), np.minimum(r + radius + 1, height)
                    c0, c1 = np.maximum(c - radius, 0), np.minimum(c + radius + 1, width)
                    return s[np.ix_(r1, c1)] - s[np.ix_(r0, c1)] - s[np.ix_(r1, c0)] + s[np.ix_(r0, c0)]

                shift = a.mean()
                n, s1, s2 = box(np.ones_like(a)), box(a - shift), box((a - shift) ** 2)
                mean = s1 / n
                lo, hi = a.copy(), a.copy()
                for axis in (0, 1):
                    src = (lo.copy(), hi.copy())
                    for d in range(1, radius + 1):
                        front = tuple(slice(d, None) if i == axis else slice(None) for i in (0, 1))
                        back = tuple(slice(None, -d) if i == axis else slice(None) for i in (0, 1))
                        for f, out, s in ((np.minimum, lo, src[0]), (np.maximum, hi, src[1])):
                            out[back] = f(out[back], s[front])
                            out[front] = f(out[front], s[back])
                for out, x in zip(outs, (mean + shift, np.sqrt(np.maximum(s2 / n - mean * mean, 0)), lo, hi), strict=True):
                    out.append(x.ravel())
            lists = [pa.array(o, pa.list_(pa.float64())) for o in outs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "mean", "std", "lo", "hi"])

    kind = dict(tiles.dtypes)[key]
    return tiles.select(key, column).mapInArrow(run, f"{key} {kind}, mean array<double>, std array<double>, lo array<double>, hi array<double>")
