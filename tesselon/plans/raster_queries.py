"""Tiles: metadata, band math, moving windows, resampling and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import spectral
from tesselon.operators import focal, masking, raster, spatial, temporal
from tesselon.plans import roles
from tesselon.plans.roles import BANDS, PIXELS, SPARSE, rounded

query = roles.Registry()
QUERIES, SQL = query.queries, query.sql


def windows(radius: int, source: str = PIXELS, value: str = "v", extra: str = "") -> str:
    """Every pixel (a) with those of its window (b): an independent neighbour join."""
    return f"""WITH px AS MATERIALIZED ({source}) SELECT a.cell, a.row, a.col, {extra} FROM px a JOIN px b
  ON a.cell = b.cell AND b.row BETWEEN a.row - {radius} AND a.row + {radius} AND b.col BETWEEN a.col - {radius} AND a.col + {radius}
  GROUP BY a.cell, a.row, a.col, a.{value}"""


@query(f"SELECT cell, CAST(max(row) + 1 AS INT) AS height, CAST(max(col) + 1 AS INT) AS width, round(min(v), 6) AS lo, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS hi, count(*) FILTER (v <> 0) AS valid FROM ({PIXELS}) GROUP BY cell")
def tile_metadata_scan(spark, sf_dir):
    return rounded(raster.metadata(roles.pixels(spark, sf_dir)))


@query(f"SELECT cell, round(max(v), 6) AS hi FROM (SELECT cell, CASE WHEN cell % 5 = 0 THEN 0 ELSE abs(v) END AS v FROM ({PIXELS})) GROUP BY cell HAVING max(v) > 0")
def empty_tile_skip(spark, sf_dir):
    px = roles.pixels(spark, sf_dir).withColumn("v", F.when(F.col("cell") % 5 == 0, 0.0).otherwise(F.abs("v")))
    return rounded(raster.empty_tiles(px))


@query(f"SELECT cell, round(avg(CASE WHEN q = 0 AND p = 0 THEN 1 ELSE 0 END), 6) AS share, avg(CASE WHEN q = 0 AND p = 0 THEN 1 ELSE 0 END) > 0.5 AS mostly FROM ({SPARSE}) GROUP BY cell")
def mostly_nodata(spark, sf_dir):
    return rounded(raster.mostly_nodata(roles.sparse(spark, sf_dir), "q", "p"))


@query(f"WITH b AS ({BANDS}) SELECT a.cell, a.row, a.col, round(a.nir, 6) AS nir_a, round(c.nir, 6) AS nir_b FROM b a JOIN b c USING (cell, row, col) WHERE a.date = 0 AND c.date = 2")
def date_pairing(spark, sf_dir):
    return rounded(temporal.pair_dates(roles.bands(spark, sf_dir), 0, 2, ["cell", "row", "col"], ["nir"]))


@query(f"SELECT cell FROM ({BANDS}) GROUP BY cell HAVING count(DISTINCT date) = 3")
def cells_in_all_dates(spark, sf_dir):
    return temporal.cells_in_all_dates(roles.bands(spark, sf_dir), 3)


@query("""SELECT c, r, round(2715098 + c * 89.6, 6) AS left, round(greatest(1120681 - r * 89.6 - 102.4, 1120181), 6) AS bottom,
  round(least(2715098 + c * 89.6 + 102.4, 2715598), 6) AS right, round(1120681 - r * 89.6, 6) AS top
  FROM (SELECT unnest(range(0, 6)) AS c), (SELECT unnest(range(0, 6)) AS r)""")
def aoi_tiling(spark, sf_dir):
    return rounded(spatial.tiling(spark, 2715098.0, 1120181.0, 2715598.0, 1120681.0, 1024, 128, 0.1))


@query(f"SELECT cell, date, row, col, round((nir - red) / (nir + red + 1e-6), 6) AS ndvi FROM ({BANDS})")
def ndvi_band_math(spark, sf_dir):
    return rounded(roles.bands(spark, sf_dir).select("cell", "date", "row", "col", spectral.ndvi(F.col("nir"), F.col("red")).alias("ndvi")))


@query(f"WITH b AS ({BANDS}) SELECT a.cell, a.row, a.col, round(a.nir, 6) AS r, round(a.red, 6) AS g, round(a.chm, 6) AS b, round(greatest(c.nir - d.nir, 0), 6) AS chm FROM b a JOIN b c USING (cell, row, col) JOIN b d USING (cell, row, col) WHERE a.date = 0 AND c.date = 1 AND d.date = 2")
def chm_diff_clip(spark, sf_dir):
    b = roles.bands(spark, sf_dir)
    on = ["cell", "row", "col"]
    rgb = b.filter("date = 0").select(*on, F.col("nir").alias("r"), F.col("red").alias("g"), F.col("chm").alias("b"))
    dsm, dtm = (b.filter(f"date = {d}").select(*on, F.col("nir").alias(n)) for d, n in ((1, "dsm"), (2, "dtm")))
    return rounded(raster.stack(dsm, dtm, rgb))


@query(f"WITH b AS ({BANDS}) SELECT 'nir' AS band, round(avg(nir), 6) AS mean, round(stddev_pop(nir), 6) AS std FROM b UNION ALL SELECT 'red', round(avg(red), 6), round(stddev_pop(red), 6) FROM b UNION ALL SELECT 'chm', round(avg(chm), 6), round(stddev_pop(chm), 6) FROM b")
def channel_stats(spark, sf_dir):
    return rounded(raster.channel_stats(roles.bands(spark, sf_dir), "nir", "red", "chm"))


@query(f"WITH b AS ({BANDS}), s AS (SELECT avg(nir) AS mn, stddev_pop(nir) AS sn, avg(red) AS mr, stddev_pop(red) AS sr FROM b) SELECT cell, date, row, col, round((nir - mn) / (sn + 1e-8), 6) AS nir, round((red - mr) / (sr + 1e-8), 6) AS red FROM b, s")
def normalize_channels(spark, sf_dir):
    return rounded(raster.normalised(roles.bands(spark, sf_dir).drop("chm"), "nir", "red"))


@query(f"WITH px AS ({PIXELS}), b AS (SELECT cell, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px GROUP BY cell) SELECT cell, row, col, round(least(greatest((v - lo) / greatest(hi - lo, 1e-6), 0), 1), 6) AS stretched FROM px JOIN b USING (cell)")
def contrast_stretch(spark, sf_dir):
    return rounded(raster.contrast_stretch(roles.pixels(spark, sf_dir)).drop("v"))


def _mean_std(radius: int):
    sql = windows(radius, extra="round(avg(b.v), 6) AS mean, round(stddev_pop(b.v), 6) AS std, count(*) AS n")

    def run(spark, sf_dir):
        out = focal.mean_std(roles.pixels(spark, sf_dir), radius).drop("v")
        return rounded(out.withColumn("n", F.col("n").cast("long")))

    run.__name__ = f"focal_mean_std_r{radius}"
    return query(sql)(run)


for _r in (1, 2, 3):
    _mean_std(_r)


@query(windows(2, extra="round(min(b.v), 6) AS lo, round(max(b.v), 6) AS hi"))
def focal_minmax(spark, sf_dir):
    return rounded(focal.minmax(roles.pixels(spark, sf_dir), 2).drop("v"))


@query(f"""WITH w AS ({windows(1, extra="avg(b.v) AS m, list(b.v) AS vs")}), c AS (SELECT *, list_transform(vs, lambda x: x - m) AS ds FROM w),
  k AS (SELECT *, list_sum(list_transform(ds, lambda x: x * x)) / len(ds) AS m2, list_sum(list_transform(ds, lambda x: x * x * x)) / len(ds) AS m3, list_sum(list_transform(ds, lambda x: x * x * x * x)) / len(ds) AS m4 FROM c)
  SELECT cell, row, col, round(CASE WHEN m2 <= 1e-6 THEN 0 ELSE m3 / pow(m2, 1.5) END, 5) AS skew, round(CASE WHEN m2 <= 1e-6 THEN 0 ELSE m4 / (m2 * m2) - 3 END, 5) AS kurt FROM k""")
def focal_skew_kurt(spark, sf_dir):
    return rounded(focal.moments(roles.pixels(spark, sf_dir), 1).drop("v"), 5)


@query(windows(1, source=f"SELECT cell, row, col, abs(v) AS v FROM ({PIXELS})", extra="round(CASE WHEN avg(b.v) > 0 THEN max(b.v) / avg(b.v) ELSE 0 END, 6) AS ratio"))
def peak_ratio(spark, sf_dir):
    return rounded(focal.peak_ratio(roles.pixels(spark, sf_dir).withColumn("v", F.abs("v")), 1).drop("v"))


LAPLACIAN = f"""SELECT cell, row, col, v, coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) - 4 * v AS lap
  FROM ({PIXELS}) WINDOW r AS (PARTITION BY cell, col ORDER BY row), c AS (PARTITION BY cell, row ORDER BY col)"""


@query(f"SELECT cell, round(var_pop(lap), 6) AS sharpness FROM ({LAPLACIAN}) GROUP BY cell")
def laplacian_sharpness(spark, sf_dir):
    return rounded(raster.sharpness(roles.pixels(spark, sf_dir)))


@query(f"""WITH s AS (SELECT cell, cell % 3 AS date, var_pop(lap) AS sharpness FROM ({LAPLACIAN}) GROUP BY cell),
  d AS (SELECT date, avg(sharpness) AS mean, quantile_cont(sharpness, 0.5) AS median, stddev_pop(sharpness) AS std FROM s GROUP BY date)
  SELECT date, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round((max(mean) OVER () - mean) / max(mean) OVER () * 100, 6) AS gap FROM d""")
def sharpness_by_date(spark, sf_dir):
    from tesselon.operators.evaluation import sharpness_ranking

    s = raster.sharpness(roles.pixels(spark, sf_dir)).withColumn("date", F.col("cell") % 3)
    return rounded(sharpness_ranking(s, "date", "sharpness"))


@query(windows(1, source=LAPLACIAN, extra="round(stddev_pop(b.lap), 6) AS rough"))
def local_roughness(spark, sf_dir):
    return rounded(focal.roughness(roles.pixels(spark, sf_dir), 1).drop("v"))


@query(f"""WITH px AS MATERIALIZED ({PIXELS}), o AS (SELECT dr, dc, least(CAST(floor((atan2(dr, dc) + CASE WHEN atan2(dr, dc) < 0 THEN 2 * pi() ELSE 0 END) / (pi() / 4)) AS INT), 7) AS sector
    FROM (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc) WHERE dr * dr + dc * dc <= 4 AND (dr <> 0 OR dc <> 0)),
  s AS (SELECT a.cell, a.row, a.col, o.sector, avg(b.v) AS m FROM px a, o, px b WHERE b.cell = a.cell AND b.row = a.row + o.dr AND b.col = a.col + o.dc GROUP BY ALL)
  SELECT cell, row, col, round(CASE WHEN count(*) < 2 THEN 0 ELSE var_pop(m) END, 6) AS asymmetry FROM s GROUP BY cell, row, col""")
def radial_asymmetry(spark, sf_dir):
    return rounded(focal.radial_asymmetry(roles.pixels(spark, sf_dir), 2))


@query(f"SELECT cell, row, col, CAST(row < 2 OR col < 2 OR row > 5 OR col > 5 AS INT) AS clipped FROM ({PIXELS})")
def window_clipped(spark, sf_dir):
    return focal.clipped(roles.pixels(spark, sf_dir), 2).drop("v")


@query(windows(1, source=f"SELECT cell, row, col, abs(v) + 1 AS v, CASE WHEN v > 0.5 THEN 1 ELSE 0 END AS m FROM ({PIXELS})", extra="round(CASE WHEN avg(b.m) < 0.1 THEN 1 ELSE a.v / avg(b.v) FILTER (b.m = 1) END, 6) AS ratio"))
def masked_focal_brightness(spark, sf_dir):
    px = roles.pixels(spark, sf_dir)
    px = px.withColumns({"m": F.col("v") > 0.5, "v": F.abs("v") + 1})
    return rounded(focal.masked_ratio(px, 1, "v", F.col("m")).drop("v", "m"))


_BLUR = f"""WITH px AS MATERIALIZED ({PIXELS}), k AS (SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS d)),
  m AS (SELECT t, d, w, CASE WHEN t + d < 0 THEN -1 - t - d WHEN t + d > 7 THEN 15 - t - d ELSE t + d END AS s FROM (SELECT unnest(range(0, 8)) AS t), k),
  a AS (SELECT cell, m.t AS row, col, sum(w * v) AS v FROM px JOIN m ON px.row = m.s GROUP BY ALL)
  SELECT cell, row, m.t AS col, sum(w * v) AS v FROM a JOIN m ON a.col = m.s GROUP BY ALL"""


@query(f"SELECT cell, row, col, round(v, 6) AS blur FROM ({_BLUR})")
def gaussian_density(spark, sf_dir):
    return rounded(focal.gaussian(roles.pixels(spark, sf_dir), 1.0, 8, 8))


@query(f"""WITH px AS MATERIALIZED ({PIXELS}), m AS (SELECT t, s, greatest(1 - abs(p - s), 0) AS w FROM (SELECT t, least(greatest((t + 0.5) / 2 - 0.5, 0), 7) AS p FROM (SELECT unnest(range(0, 16)) AS t)), (SELECT unnest(range(0, 8)) AS s) WHERE abs(p - s) < 1)
  SELECT cell, r.t AS row, c.t AS col, round(sum(r.w * c.w * v), 6) AS v FROM px JOIN m r ON px.row = r.s JOIN m c ON px.col = c.s GROUP BY ALL""")
def resample_bilinear(spark, sf_dir):
    return rounded(raster.resample_bilinear(roles.pixels(spark, sf_dir), 2, 8, 8))


@query(f"WITH p AS (SELECT vec_id AS cell, vec_id % 8 AS row, label % 8 AS col FROM embeddings) SELECT DISTINCT cell, row + dr AS row, col + dc AS col FROM p, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc) WHERE dr * dr + dc * dc < 9 AND row + dr BETWEEN 0 AND 7 AND col + dc BETWEEN 0 AND 7")
def rasterize_disks(spark, sf_dir):
    p = roles.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), (F.col("vec_id") % 8).alias("row"), (F.col("label") % 8).alias("col"))
    return raster.rasterise_disks(p, 3, 8, 8)


@query(f"SELECT l_suppkey % 4 AS cell, l_orderkey % 64 AS row, l_partkey % 64 AS col, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL")
def point_counts(spark, sf_dir):
    p = roles.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("cell"), (F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"))
    return raster.point_counts(p)


@query(f"WITH w AS ({windows(1, extra='a.v AS v, avg(b.v) AS m')}) SELECT cell, round(avg(v - m), 6) AS contrast, round(max(v - m), 6) AS most, round(stddev_pop(v - m), 6) AS spread FROM w GROUP BY cell")
def focal_contrast(spark, sf_dir):
    px = focal.mean_std(roles.pixels(spark, sf_dir), 1).withColumn("d", F.col("v") - F.col("mean"))
    return rounded(px.groupBy("cell").agg(F.avg("d").alias("contrast"), F.max("d").alias("most"), F.stddev_pop("d").alias("spread")))


def _shade(source: str) -> str:
    return f"""WITH g AS (SELECT cell, row, col, v, lag(v) OVER r AS ru, lead(v) OVER r AS rd, lag(v) OVER c AS cl, lead(v) OVER c AS cr FROM ({source}) WINDOW r AS (PARTITION BY cell, col ORDER BY row), c AS (PARTITION BY cell, row ORDER BY col)),
  s AS (SELECT cell, row, col, CASE WHEN ru IS NULL THEN rd - v WHEN rd IS NULL THEN v - ru ELSE (rd - ru) / 2 END AS dy, CASE WHEN cl IS NULL THEN cr - v WHEN cr IS NULL THEN v - cl ELSE (cr - cl) / 2 END AS dx FROM g)
  SELECT cell, row, col, round(least(greatest(((-dx * cos(radians(-225)) * cos(radians(35)) + dy * sin(radians(-225)) * cos(radians(35)) + sin(radians(35))) / sqrt(dx * dx + dy * dy + 1) + 1) / 2, 0), 1), 6) AS shade FROM s"""


@query(_shade(PIXELS))
def hillshade(spark, sf_dir):
    return rounded(focal.hillshade(roles.pixels(spark, sf_dir)).drop("v"))


@query(f"""WITH b AS ({BANDS}), p AS (SELECT a.cell, a.row, a.col, (a.nir - a.red) / (a.nir + a.red + 1e-6) AS na, (c.nir - c.red) / (c.nir + c.red + 1e-6) AS nb, a.nir + a.red + a.chm AS bright FROM b a JOIN b c USING (cell, row, col) WHERE a.date = 0 AND c.date = 1)
  SELECT cell, row, col, round(na, 6) AS ndvi_a, round(nb, 6) AS ndvi_b, round(na - nb, 6) AS drop_ab, round(bright, 6) AS bright FROM p""")
def build_views(spark, sf_dir):
    b = roles.bands(spark, sf_dir)
    p = temporal.pair_dates(b, 0, 1, ["cell", "row", "col"], ["nir", "red", "chm"])
    a, c = spectral.ndvi(F.col("nir_a"), F.col("red_a")), spectral.ndvi(F.col("nir_b"), F.col("red_b"))
    return rounded(p.select("cell", "row", "col", a.alias("ndvi_a"), c.alias("ndvi_b"), (a - c).alias("drop_ab"), spectral.brightness(F.col("nir_a"), F.col("red_a"), F.col("chm_a")).alias("bright")))


@query(f"SELECT cell, row * 2 + a AS row, col * 2 + b AS col, round(v, 6) AS v FROM ({PIXELS}), (SELECT unnest(range(0, 2)) AS a), (SELECT unnest(range(0, 2)) AS b) WHERE row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5".replace("row * 2", "(row - 2) * 2").replace("col * 2", "(col - 2) * 2"))
def crop_and_upsample(spark, sf_dir):
    return rounded(raster.upsample_nearest(raster.centre_crop(roles.pixels(spark, sf_dir), 4, 8, 8), 2))


@query(f"WITH s AS ({SPARSE}) SELECT cell, row, col, round(arg_min(q, date), 6) AS q FROM s WHERE q <> 0 GROUP BY cell, row, col")
def mosaic_first_source(spark, sf_dir):
    s = roles.sparse(spark, sf_dir).withColumn("q", F.when(F.col("q") != 0, F.col("q")))
    return rounded(raster.mosaic(s, F.col("date"), "q"))


@query(f"WITH s AS ({SPARSE}), ref AS (SELECT cell, row, col FROM s WHERE date = 'N') SELECT cell, row, col, round(coalesce(q, 0), 6) AS q FROM ref LEFT JOIN (SELECT cell, row, col, q FROM s WHERE date = 'R') USING (cell, row, col)")
def aligned_to_reference(spark, sf_dir):
    s = roles.sparse(spark, sf_dir)
    return rounded(raster.aligned_to(s.filter("date = 'N'"), s.filter("date = 'R'"), "q"))


@query(windows(2, extra="round(avg(b.v), 6) AS mean, round(stddev_pop(b.v), 6) AS std, round(min(b.v), 6) AS lo, round(max(b.v), 6) AS hi"))
def focal_kernel_tier(spark, sf_dir):
    """The same statistics from whole tiles by the array kernel."""
    tiles = roles.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("values"))
    out = focal.kernel_stats(tiles, 2, 8, 8).select("cell", F.posexplode(F.arrays_zip("mean", "std", "lo", "hi")).alias("p", "s"))
    return rounded(out.select("cell", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).cast("int").alias("col"), "s.mean", "s.std", "s.lo", "s.hi"))


_POINTS = "SELECT vec_id AS id, vec_id AS cell, vec_id % 8 AS row, label % 8 AS col FROM embeddings"


def _points(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("cell"), (F.col("vec_id") % 8).cast("int").alias("row"), (F.col("label") % 8).cast("int").alias("col"))


@query(f"WITH p AS (SELECT id, cell, least(greatest(row - 2, 0), 3) AS t, least(greatest(col - 2, 0), 3) AS l FROM ({_POINTS})) SELECT id, px.row - t AS i, px.col - l AS j, round(v, 6) AS v FROM p JOIN ({PIXELS}) px ON px.cell = p.cell AND px.row BETWEEN t AND t + 4 AND px.col BETWEEN l AND l + 4")
def crops_at_points(spark, sf_dir):
    return rounded(raster.crops(_points(spark, sf_dir), roles.pixels(spark, sf_dir), 2, 8, 8).withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")}))


@query(f"WITH p AS ({_POINTS}), c AS (SELECT p.id, CASE WHEN v > 0 THEN v ELSE 0 END AS v FROM p JOIN ({PIXELS}) px ON px.cell = p.cell AND abs(px.row - p.row) <= 2 AND abs(px.col - p.col) <= 2 WHERE p.row BETWEEN 2 AND 5 AND p.col BETWEEN 2 AND 5) SELECT id, round(avg(v), 6) AS mean, count(*) AS n FROM c GROUP BY id HAVING avg(CASE WHEN v = 0 THEN 1 ELSE 0 END) <= 0.5")
def windows_with_full_margin(spark, sf_dir):
    px = roles.pixels(spark, sf_dir).withColumn("v", F.greatest("v", F.lit(0.0)))
    kept = raster.crops_with_data(raster.crops(_points(spark, sf_dir), px, 2, 8, 8, clamp=False))
    return rounded(kept.groupBy("id").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")))


@query(f"""WITH c AS (SELECT cell, row, col, '11_' || cell || '_' || row || '_' || col AS name FROM ({BANDS}) WHERE date = 0 AND chm BETWEEN 0.5 AND 4), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5(name), name) AS n FROM c)
  SELECT cell, row, col FROM (SELECT * FROM r WHERE n <= 2 ORDER BY md5('11_' || cell), md5(name) LIMIT 60)""")
def canopy_controls(spark, sf_dir):
    from tesselon.operators import sampling

    px = roles.bands(spark, sf_dir).filter("date = 0")
    return sampling.controls(px, F.col("chm").between(0.5, 4.0), 2, 60, "11").select("cell", "row", "col")


@query(f"SELECT cell, row, col, (row // 4) * 2 + col // 4 AS patch, (row % 4) * 4 + col % 4 AS token, round(v, 6) AS v FROM ({PIXELS})")
def patchify(spark, sf_dir):
    return rounded(masking.patchify(roles.pixels(spark, sf_dir), 4, 8))


_MASK = "SELECT vec_id AS cell, patch, row_number() OVER (PARTITION BY vec_id ORDER BY md5('7_' || vec_id || '_' || patch), patch) - 1 AS restore FROM embeddings, (SELECT unnest(range(0, 16)) AS patch)"


@query(f"SELECT cell, patch, restore, CAST(restore >= 4 AS INT) AS masked FROM ({_MASK})")
def random_masking(spark, sf_dir):
    patches = roles.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("patch"))
    return masking.random_mask(patches, 16, 0.75, "7")


@query(f"""WITH t AS (SELECT cell, (row // 2) * 4 + col // 2 AS patch, v, v * 0.9 + 0.01 AS pred FROM ({PIXELS})), e AS (SELECT t.cell, t.patch, avg((pred - v) * (pred - v)) AS l FROM t JOIN ({_MASK}) m ON t.cell = m.cell AND t.patch = m.patch WHERE restore >= 4 GROUP BY ALL)
  SELECT cell, round(avg(l), 6) AS loss FROM e GROUP BY cell""")
def masked_mse(spark, sf_dir):
    tokens = masking.patchify(roles.pixels(spark, sf_dir), 2, 8).withColumn("pred", F.col("v") * 0.9 + 0.01)
    mask = random_masking(spark, sf_dir).select("cell", "patch", "masked")
    return rounded(masking.masked_mse(tokens.join(mask, ["cell", "patch"]), "v", "pred"))


@query("SELECT epoch, round(CASE WHEN epoch < 10 THEN 0.00015 * epoch / 10 ELSE 0.00015 * 0.5 * (1 + cos(pi() * (epoch - 10) / 190.0)) END, 12) AS lr FROM (SELECT unnest(range(0, 201)) AS epoch)")
def lr_schedule(spark, sf_dir):
    return rounded(spark.range(201).select(F.col("id").alias("epoch"), masking.learning_rate(F.col("id"), 10, 200, 0.00015).alias("lr")), 12)


@query(_shade(_BLUR))
def crown_relief(spark, sf_dir):
    """The shaded relief of blurred tiles, so that noise doesn't hide what is a metre wide."""
    return rounded(focal.hillshade(focal.gaussian(roles.pixels(spark, sf_dir), 1.0, 8, 8), value="blur").drop("blur"))


_AREA = f"SELECT cell // 16 * 8 + row AS row, cell % 16 * 8 + col AS col, CASE WHEN cell % 16 < 6 THEN 0 ELSE abs(v) END AS v FROM ({PIXELS})"


@query(f"""WITH px AS ({_AREA}), t AS (SELECT r, c, px.row - r * 16 AS row, px.col - c * 16 AS col, v FROM px JOIN (SELECT unnest(range(0, 200)) AS r) ON px.row BETWEEN r * 16 AND r * 16 + 19 JOIN (SELECT unnest(range(0, 20)) AS c) ON px.col BETWEEN c * 16 AND c * 16 + 19),
  kept AS (SELECT r, c FROM t GROUP BY r, c HAVING max(v) <> 0 ORDER BY r, c LIMIT 40) SELECT r, c, row, col, round(v, 6) AS v FROM t JOIN kept USING (r, c)""")
def cut_tiles(spark, sf_dir):
    """The first 40 tiles with data that an area is cut into, 20 pixels wide and overlapping by 4."""
    px = roles.pixels(spark, sf_dir)
    area = px.select((F.floor(F.col("cell") / 16) * 8 + F.col("row")).cast("int").alias("row"), (F.col("cell") % 16 * 8 + F.col("col")).cast("int").alias("col"), F.when(F.col("cell") % 16 < 6, 0.0).otherwise(F.abs("v")).alias("v"))
    return rounded(raster.cut_tiles(area, 20, 4, most=40))


@query(f"""WITH b AS ({BANDS}), q AS (SELECT cell, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM (SELECT cell, unnest([nir, red]) AS v FROM b WHERE date = 0) GROUP BY cell)
  SELECT cell, row, col, round(least(greatest((a.nir - lo) / greatest(hi - lo, 1e-6), 0), 1), 6) AS nir, round(least(greatest((a.red - lo) / greatest(hi - lo, 1e-6), 0), 1), 6) AS red, round(s.chm, 6) AS chm
  FROM b a JOIN b s USING (cell, row, col) JOIN q USING (cell) WHERE a.date = 0 AND s.date = 1""")
def backdrop(spark, sf_dir):
    b = roles.bands(spark, sf_dir)
    return rounded(raster.backdrop(b.filter("date = 0").drop("date", "chm"), b.filter("date = 1").select("cell", "row", "col", "chm"), ["nir", "red"]))


@query(f"SELECT split, round(avg(loss), 6) AS loss, count(*) AS n FROM (SELECT CASE WHEN cell % 5 = 0 THEN 'val' ELSE 'train' END AS split, loss FROM (WITH t AS (SELECT cell, (row // 2) * 4 + col // 2 AS patch, v, v * 0.9 + 0.01 AS pred FROM ({PIXELS})), e AS (SELECT t.cell, t.patch, avg((pred - v) * (pred - v)) AS l FROM t JOIN ({_MASK}) m ON t.cell = m.cell AND t.patch = m.patch WHERE restore >= 4 GROUP BY ALL) SELECT cell, avg(l) AS loss FROM e GROUP BY cell)) GROUP BY split")
def mean_losses(spark, sf_dir):
    """Mean reconstruction loss of the training and the held-out tiles."""
    tokens = masking.patchify(roles.pixels(spark, sf_dir), 2, 8).withColumn("pred", F.col("v") * 0.9 + 0.01)
    loss = masking.masked_mse(tokens.join(random_masking(spark, sf_dir).select("cell", "patch", "masked"), ["cell", "patch"]), "v", "pred")
    split = F.when(F.col("cell") % 5 == 0, "val").otherwise("train").alias("split")
    return rounded(loss.groupBy(split).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n")))
