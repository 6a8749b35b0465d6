"""Moving windows against numpy on small tiles, edges included."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import focal, raster


def tile(spark, a, cell=0):
    return spark.createDataFrame([(cell, r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "cell int, row int, col int, v double")


def window(a, r, c, n):
    return a[max(r - n, 0) : r + n + 1, max(c - n, 0) : c + n + 1]


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(3).normal(10, 3, (9, 12))


def by_pixel(df, *columns):
    return {(r["row"], r["col"]): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("radius", [1, 3])
def test_statistics(spark, image, radius):
    px = tile(spark, image)
    got = by_pixel(focal.mean_std(px, radius), "n", "mean", "std")
    ends = by_pixel(focal.minmax(px, radius), "lo", "hi")
    shape = by_pixel(focal.moments(px, radius), "skew", "kurt")
    ratio = by_pixel(focal.peak_ratio(px, radius), "ratio")
    for (r, c), (n, mean, std) in got.items():
        w = window(image, r, c, radius).ravel()
        z = (w - w.mean()) / w.std()
        assert (n, mean, std) == pytest.approx((w.size, w.mean(), w.std()))
        assert ends[r, c] == (w.min(), w.max())
        assert shape[r, c] == pytest.approx(((z**3).mean(), (z**4).mean() - 3), abs=1e-8)
        assert ratio[r, c][0] == pytest.approx(w.max() / w.mean())


def test_corner_edge_and_inner_windows(spark):
    got = by_pixel(focal.mean_std(tile(spark, np.arange(25).reshape(5, 5)), 1), "n")
    assert (got[0, 0][0], got[0, 2][0], got[2, 2][0]) == (4, 6, 9)


def test_flat_tiles(spark):
    px = tile(spark, np.full((5, 5), 7.0))
    assert set(by_pixel(focal.moments(px, 1), "skew", "kurt").values()) == {(0.0, 0.0)}
    assert set(by_pixel(focal.roughness(px, 1), "rough").values()) == {(0.0,)}
    assert set(by_pixel(focal.radial_asymmetry(px, 2), "asymmetry").values()) == {(0.0,)}
    assert set(by_pixel(focal.peak_ratio(px, 1), "ratio").values()) == {(1.0,)}
    assert set(by_pixel(focal.peak_ratio(tile(spark, np.zeros((3, 3))), 1), "ratio").values()) == {(0.0,)}


def test_laplacian_and_roughness(spark, image):
    padded = np.pad(image, 1, mode="edge")
    lap = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * image
    got = by_pixel(focal.laplacian(tile(spark, image)), "lap")
    rough = by_pixel(focal.roughness(tile(spark, image), 2), "rough")
    for (r, c), (v,) in got.items():
        assert v == pytest.approx(lap[r, c])
        assert rough[r, c][0] == pytest.approx(window(lap, r, c, 2).std())
    assert raster.sharpness(tile(spark, image)).first()["sharpness"] == pytest.approx(lap.var())


def test_radial_asymmetry(spark, image):
    offsets = focal.sector_offsets(2)
    got = by_pixel(focal.radial_asymmetry(tile(spark, image), 2), "asymmetry")
    for (r, c), (v,) in got.items():
        sectors = {}
        for dr, dc, s in offsets:
            if 0 <= r + dr < image.shape[0] and 0 <= c + dc < image.shape[1]:
                sectors.setdefault(s, []).append(image[r + dr, c + dc])
        means = [np.mean(x) for x in sectors.values()]
        assert v == pytest.approx(np.var(means) if len(means) > 1 else 0.0)


def test_gaussian_with_reflected_edges(spark, image):
    sigma, r = 1.3, int(4 * 1.3 + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    want = image
    for axis in (0, 1):
        padded = np.pad(want, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.apply_along_axis(lambda x: np.convolve(x, k, "valid"), axis, padded)
    got = by_pixel(focal.gaussian(tile(spark, image), sigma, *image.shape), "blur")
    assert all(v == pytest.approx(want[p]) for p, (v,) in got.items()) and len(got) == image.size
    total = focal.gaussian(tile(spark, image), sigma, *image.shape).agg(F.sum("blur")).first()[0]
    assert total == pytest.approx(image.sum())


def test_masked_ratio_falls_back(spark, image):
    px = tile(spark, image).withColumn("m", F.col("v") > 14)
    got = by_pixel(focal.masked_ratio(px, 1, "v", F.col("m")), "ratio")
    for (r, c), (v,) in got.items():
        w = window(image, r, c, 1)
        assert v == pytest.approx(1.0 if (w > 14).mean() < 0.1 else image[r, c] / w[w > 14].mean())


def test_adjacent_equal_maxima_are_both_peaks(spark):
    a = np.zeros((5, 5))
    a[2, 2] = a[2, 3] = 0.9
    a[0, 0] = 0.4
    assert {(r["row"], r["col"]) for r in focal.peaks(tile(spark, a), 1, 0.5).collect()} == {(2, 2), (2, 3)}
    nothing = tile(spark, a).withColumn("v", F.lit(None).cast("double"))
    assert focal.peaks(nothing, 1, 0.5).count() == 0


def test_kernel_tier_equals_relational_tier(spark, image):
    tiles = spark.createDataFrame([(0, image.ravel().tolist())], "cell int, values array<double>")
    k = focal.kernel_stats(tiles, 2, *image.shape).first()
    got = by_pixel(focal.mean_std(tile(spark, image), 2), "mean", "std")
    ends = by_pixel(focal.minmax(tile(spark, image), 2), "lo", "hi")
    for (r, c), v in got.items():
        i = r * image.shape[1] + c
        assert (k["mean"][i], k["std"][i]) == pytest.approx(v) and (k["lo"][i], k["hi"][i]) == ends[r, c]


def test_windows_commute_with_translation(spark, image):
    moved = tile(spark, image).withColumns({"row": F.col("row") + 100, "col": F.col("col") - 7})
    a, b = by_pixel(focal.mean_std(tile(spark, image), 2), "std"), by_pixel(focal.mean_std(moved, 2), "std")
    assert all(b[r + 100, c - 7] == pytest.approx(v) for (r, c), v in a.items())


def test_clipped_and_hillshade(spark, image):
    got = by_pixel(focal.clipped(tile(spark, image), 2), "clipped")
    assert got[0, 5] == (1,) and got[2, 2] == (0,) and got[8, 11] == (1,)
    shade = by_pixel(focal.hillshade(tile(spark, np.zeros((3, 3)))), "shade")
    assert set(shade.values()) == {((math.sin(math.radians(35)) + 1) / 2,)}


def test_resample_holds_edges_and_mean(spark, image):
    out = raster.resample_bilinear(tile(spark, image), 5, *image.shape)
    got = by_pixel(out, "v")
    assert len(got) == image.size * 25 and got[0, 0][0] == pytest.approx(image[0, 0])
    assert got[7, 7][0] == pytest.approx(image[1, 1])  # the centre of a source pixel
