"""Grid scoring and dense surfaces end to end: locations or pixels, features over dates, a model, ranked rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import spectral
from tesselon.functions.grid import Grid, pixel_centre
from tesselon.operators import features, models, scoring, spatial
from tesselon.operators.temporal import capped
from tesselon.plans import roles
from tesselon.plans.roles import BANDS, X0, Y0, rounded

query = roles.Registry()
QUERIES, SQL = query.queries, query.sql

#: Cells of 8 x 4 pixels of 1 m, 16 a row, that overlap by 2 and 1 m; a pixel with little infrared holds no data.
ACROSS, STEP, HEIGHT, WIDTH, RES = 16, (6.0, 3.0), 4, 8, 1.0
FAINT, SPACING, NEAR = 0.02, 2.5, 3.0
VALUES = ["ndvi_point", "chm_point"]


def pixels(spark, sf_dir):
    b = roles.bands(spark, sf_dir)
    seen = F.col("nir") >= FAINT
    kept = [F.when(seen, F.col(c)).otherwise(0.0).alias(c) for c in ("nir", "red", "chm")]
    return b.select(_name().alias("cell"), "date", "row", "col", *kept).withColumn("ndvi", spectral.ndvi(F.col("nir"), F.col("red")))


def _name():
    return Grid().key(F.col("cell") % ACROSS, F.floor(F.col("cell") / ACROSS))


def tiles(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("cell"), (F.col("vec_id") % 3).alias("date"))
    left, top = X0 + (F.col("cell") % ACROSS) * STEP[0], Y0 - F.floor(F.col("cell") / ACROSS) * STEP[1]
    return e.select(_name().alias("cell"), "date", left.alias("x0"), (top - HEIGHT * RES).alias("y0"), (left + WIDTH * RES).alias("x1"), top.alias("y1"), F.lit(RES).alias("res"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"))


def reviewed(spark, sf_dir):
    """The centres of the cells whose label is 0 on the first date."""
    e = roles.table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0 and label = 0").select((F.col("vec_id") / 3).alias("c"))
    return e.select((X0 + (F.col("c") % ACROSS) * STEP[0] + WIDTH / 2).alias("x"), (Y0 - F.floor(F.col("c") / ACROSS) * STEP[1] - HEIGHT / 2).alias("y"))


def _windows(spark, sf_dir):
    return features.band_windows(pixels(spark, sf_dir), ["ndvi", "chm"], (1, 2), ("cell", "date"))


def valid():
    return spectral.is_valid(*[F.col(c) for c in ("nir", "red", "chm")])


FEATURES = [f"{b}_{s}" for b in ("ndvi", "chm") for s in ("point", "mean_1", "std_1", "max_1", "min_1", "mean_2", "std_2", "max_2", "min_2", "contrast", "point_std", "point_range")]

_PX = f"SELECT printf('c%03d_r%03d', cell % {ACROSS}, cell // {ACROSS}) AS name, cell, date, row, col, nir, red, chm, (nir - red) / (nir + red + 1e-6) AS ndvi FROM (SELECT cell, date, row, col, CASE WHEN nir >= {FAINT} THEN nir ELSE 0 END AS nir, CASE WHEN nir >= {FAINT} THEN red ELSE 0 END AS red, CASE WHEN nir >= {FAINT} THEN chm ELSE 0 END AS chm FROM ({BANDS}))"
_STATS = ", ".join(f"avg(b.{v}) FILTER ({near}) AS {v}_mean_{r}, stddev_pop(b.{v}) FILTER ({near}) AS {v}_std_{r}, max(b.{v}) FILTER ({near}) AS {v}_max_{r}, min(b.{v}) FILTER ({near}) AS {v}_min_{r}" for v in ("ndvi", "chm") for r in (1, 2) for near in (f"abs(a.row - b.row) <= {r} AND abs(a.col - b.col) <= {r}",))
_FEATURED = f"SELECT a.name, a.cell, a.date, a.row, a.col, a.ndvi, a.chm, {_STATS} FROM px a JOIN px b ON a.cell = b.cell AND a.date = b.date AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 WHERE a.nir <> 0 OR a.red <> 0 OR a.chm <> 0 GROUP BY a.name, a.cell, a.date, a.row, a.col, a.ndvi, a.chm"
_SHOWN = ", ".join([f"round({v}_{s}, 6) AS {v}_{s}" for v in ("ndvi", "chm") for s in ("mean_1", "std_1", "max_1", "min_1", "mean_2", "std_2", "max_2", "min_2")] + [f"round({v}, 6) AS {v}_point, round({v} - {v}_mean_2, 6) AS {v}_contrast, round(stddev_pop({v}) OVER w, 6) AS {v}_point_std, round(max({v}) OVER w - min({v}) OVER w, 6) AS {v}_point_range" for v in ("ndvi", "chm")])
_TILES = f"SELECT *, x0 + {WIDTH} AS x1, y1 - {HEIGHT} AS y0 FROM (SELECT vec_id // 3 AS cell, vec_id % 3 AS date, {X0}::DOUBLE + ((vec_id // 3) % {ACROSS}) * {STEP[0]} AS x0, {Y0}::DOUBLE - ((vec_id // 3) // {ACROSS}) * {STEP[1]} AS y1 FROM embeddings)"
_GRID = f"""ext AS (SELECT min(x0) AS l, min(y0) AS b, CAST(ceil((max(x1) - min(x0)) / {SPACING} - 1e-9) AS BIGINT) AS nx, CAST(ceil((max(y1) - min(y0)) / {SPACING} - 1e-9) AS BIGINT) AS ny FROM tiles),
  g AS (SELECT i AS id, l + (i % nx) * {SPACING}::DOUBLE AS x, b + (i // nx) * {SPACING}::DOUBLE AS y FROM ext, unnest(range(0, nx * ny)) t(i)),
  rev AS (SELECT {X0}::DOUBLE + ((vec_id // 3) % {ACROSS}) * {STEP[0]} + {WIDTH / 2} AS x, {Y0}::DOUBLE - ((vec_id // 3) // {ACROSS}) * {STEP[1]} - {HEIGHT / 2} AS y FROM embeddings WHERE vec_id % 3 = 0 AND label = 0),
  kept AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM rev WHERE sqrt((rev.x - g.x) ** 2 + (rev.y - g.y) ** 2) < {NEAR}))"""


def _located(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return t, scoring.grid_locations(t, SPACING, reviewed(spark, sf_dir), NEAR)


@query(f"""WITH px AS MATERIALIZED ({_PX}), tiles AS ({_TILES}), {_GRID}, f AS ({_FEATURED}),
  s AS (SELECT id, x, y, cell, date, least(floor(y1 - y), {HEIGHT - 1}) AS row, least(floor(x - x0), {WIDTH - 1}) AS col FROM kept JOIN tiles ON x > x0 AND x < x1 AND y > y0 AND y < y1)
  SELECT id, round(x, 6) AS x, round(y, 6) AS y, name AS cell, date, {_SHOWN}, count(*) OVER w AS n_dates FROM s JOIN f USING (cell, date, row, col) WINDOW w AS (PARTITION BY id)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC, name) = 1""")
def grid_location_features(spark, sf_dir):
    """Every location of the grid that is covered and not reviewed, with the features that a model scores."""
    t, places = _located(spark, sf_dir)
    rows = scoring.location_features(places, t, _windows(spark, sf_dir), valid(), VALUES, WIDTH * RES)
    return rounded(rows.drop("nir", "red", "chm", "ndvi"))


@query(f"""WITH px AS MATERIALIZED ({_PX}), f AS ({_FEATURED}) SELECT name AS cell, row, col, date, {_SHOWN}, count(*) OVER w AS n_dates FROM f WINDOW w AS (PARTITION BY cell, row, col)
  QUALIFY row_number() OVER (PARTITION BY cell, row, col ORDER BY date DESC) = 1""")
def dense_feature_stack(spark, sf_dir):
    """Every pixel's features from its newest valid date, with the stability over all valid ones."""
    return rounded(scoring.dense_stack(_windows(spark, sf_dir), valid(), VALUES).drop("nir", "red", "chm", "ndvi"))


def _model(spark, stack, sf_dir):
    """A forest of the pixels at the cells' centres, labelled by their first date."""
    e = roles.table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0").select((F.col("vec_id") / 3).cast("long").alias("cell"), (F.col("label") >= 5).cast("int").alias("label"))
    train = stack.filter(f"row = {HEIGHT // 2} and col = {WIDTH // 2}").join(e.select(_name().alias("cell"), "label"), "cell")
    return models.build_model("rf", FEATURES, n=50, max_depth=6).fit(models.weighted(train))


@query()
def grid_scores(spark, sf_dir):
    """The whole run: grid, exclusion, coverage, features over dates, a production model, and all locations ranked."""
    t, places = _located(spark, sf_dir)
    windows = _windows(spark, sf_dir)
    model = _model(spark, scoring.dense_stack(windows, valid(), VALUES), sf_dir)
    return rounded(scoring.scored_grid(model, scoring.location_features(places, t, windows, valid(), VALUES, WIDTH * RES)))


@query()
def dense_surface(spark, sf_dir):
    """The probability of every pixel, as rows for the GeoTIFF sink: one raster a cell."""
    windows = _windows(spark, sf_dir)
    stack = scoring.dense_stack(windows, valid(), VALUES)
    return scoring.rasters(scoring.dense_surface(_model(spark, stack, sf_dir), stack, windows), tiles(spark, sf_dir))


@query(f"""WITH px AS ({_PX}), tiles AS ({_TILES}), rev AS (SELECT {X0}::DOUBLE + ((vec_id // 3) % {ACROSS}) * {STEP[0]} + {WIDTH / 2} AS x, {Y0}::DOUBLE - ((vec_id // 3) // {ACROSS}) * {STEP[1]} - {HEIGHT / 2} AS y FROM embeddings WHERE vec_id % 3 = 0 AND label = 0),
  c AS (SELECT p.cell, p.name, p.row, p.col, x0 + p.col + 0.5 AS x, y1 - p.row - 0.5 AS y FROM px p JOIN tiles t USING (cell, date) JOIN px q ON q.cell = p.cell AND q.row = p.row AND q.col = p.col AND q.date = 1 AND (q.nir <> 0 OR q.red <> 0 OR q.chm <> 0) WHERE p.date = 0 AND p.chm BETWEEN 0.5 AND 4),
  r AS (SELECT name AS cell, row, col, x, y, row_number() OVER (PARTITION BY name ORDER BY md5('11_' || name || '_' || row || '_' || col)) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM rev WHERE sqrt((rev.x - c.x) ** 2 + (rev.y - c.y) ** 2) < 3))
  SELECT cell, row, col, round(x, 4) AS x, round(y, 4) AS y FROM r WHERE n <= 2""")
def controls_away_from_palms(spark, sf_dir):
    """Two canopy pixels a cell of a height range, that another date covers too, away from reviewed points."""
    px, place = pixels(spark, sf_dir), tiles(spark, sf_dir).filter("date = 0")
    on = ["cell", "row", "col"]
    tall = px.filter((F.col("date") == 0) & F.col("chm").between(0.5, 4.0)).join(px.filter((F.col("date") == 1) & valid()).select(*on), on, "left_semi")
    centre = pixel_centre(F.col("col"), F.col("row"), F.col("x0"), F.col("y1"), RES)
    placed = tall.join(place.select("cell", "x0", "y1"), "cell").select(*on, centre[0].alias("x"), centre[1].alias("y")).withColumn("id", F.concat_ws("_", F.lit("11"), *on))
    away = spatial.not_within(placed, reviewed(spark, sf_dir), NEAR)
    return rounded(capped(away, ["cell"], F.col("id"), 2).drop("id"), 4)
