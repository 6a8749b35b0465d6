"""Evaluation of scores: summaries, curves, folds, peaks and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselon.operators import evaluation, focal, matching
from tesselon.plans import roles
from tesselon.plans.raster_queries import windows
from tesselon.plans.roles import CANDIDATES, rounded

query = roles.Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"SELECT round(avg(prob), 6) AS mean, round(quantile_cont(prob, 0.5), 6) AS median, round(stddev_pop(prob), 6) AS std, round(min(prob), 6) AS lo, round(max(prob), 6) AS hi, count(DISTINCT tile) AS keys, count(*) FILTER (prob > 0.5) AS positive FROM ({CANDIDATES})")
def score_summary(spark, sf_dir):
    return rounded(evaluation.summary(roles.candidates(spark, sf_dir), "prob", "tile"))


@query(f"SELECT CAST(least(floor(prob * 10), 9) AS INT) AS bin, count(*) AS n FROM ({CANDIDATES}) GROUP BY 1")
def score_histogram(spark, sf_dir):
    return evaluation.histogram(roles.candidates(spark, sf_dir), "prob")


@query(f"SELECT count(*) FILTER (prob > 0.9) AS over_90, count(*) FILTER (prob > 0.95) AS over_95, count(*) FILTER (prob > 0.99) AS over_99 FROM ({CANDIDATES})")
def score_tails(spark, sf_dir):
    return evaluation.tails(roles.candidates(spark, sf_dir), "prob")


@query(f"SELECT p, round(value, 6) AS value, round(share, 6) AS share FROM (SELECT unnest([0.5, 0.9, 0.99, 0.999]::DOUBLE[]) AS p, unnest(quantile_cont(prob, [0.5, 0.9, 0.99, 0.999])) AS value, avg(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) AS share FROM ({CANDIDATES}))")
def quantiles(spark, sf_dir):
    return rounded(evaluation.quantiles(roles.candidates(spark, sf_dir), "prob", (0.5, 0.9, 0.99, 0.999)))


@query(f"""WITH r AS (SELECT tile, label, rank() OVER (PARTITION BY tile ORDER BY prob) + (count(*) OVER (PARTITION BY tile, prob) - 1) / 2.0 AS r FROM ({CANDIDATES})), a AS (SELECT tile, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM r GROUP BY tile)
  SELECT tile, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS folded FROM a""")
def roc_auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(roles.candidates(spark, sf_dir), ["tile"], F.col("label"), "prob"))


_FOLDS = f"SELECT tile, count(*) FILTER (label = 1 AND p = 1) AS true_pos, count(*) FILTER (label = 0 AND p = 0) AS true_neg, count(*) FILTER (label = 0 AND p = 1) AS false_pos, count(*) FILTER (label = 1 AND p = 0) AS false_neg, avg(CASE WHEN label = p THEN 1 ELSE 0 END) AS accuracy FROM (SELECT *, CAST(prob > 0.5 AS INT) AS p FROM ({CANDIDATES})) GROUP BY tile"


def _folds(spark, sf_dir):
    return evaluation.confusion(roles.candidates(spark, sf_dir), ["tile"], F.col("label"), (F.col("prob") > 0.5).cast("int"))


@query(f"SELECT tile, true_pos, true_neg, false_pos, false_neg, round(accuracy, 6) AS accuracy FROM ({_FOLDS})")
def confusion_by_fold(spark, sf_dir):
    return rounded(_folds(spark, sf_dir))


@query(f"SELECT round(sum(true_pos + true_neg) / sum(true_pos + true_neg + false_pos + false_neg), 6) AS pooled_accuracy, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS fold_accuracy_std FROM ({_FOLDS})")
def pooled_accuracy(spark, sf_dir):
    return rounded(evaluation.pooled(_folds(spark, sf_dir)))


@query(f"SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1) * 2, 6) AS pos_weight FROM ({CANDIDATES})")
def class_weights(spark, sf_dir):
    return rounded(evaluation.class_weights(roles.candidates(spark, sf_dir), F.col("label"), 2.0))


_PEAKS = f"SELECT cell, row, col, v FROM ({windows(1, extra='a.v AS v, max(b.v) AS hi')}) WHERE v = hi AND v >= 0.15"


def _peaks(spark, sf_dir):
    return focal.peaks(roles.pixels(spark, sf_dir), 1, 0.15)


@query(f"SELECT cell, row, col, round(v, 6) AS v FROM ({_PEAKS})")
def nms_peaks(spark, sf_dir):
    return rounded(_peaks(spark, sf_dir))


def _points(peaks, *more):
    return peaks.select("cell", *more, (F.col("row") * 8 + F.col("col")).cast("long").alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))


def _true(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), "label")
    return e.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("cell", F.col("id").cast("long"), ((F.col("cell") + F.col("id") * 3) % 8).cast("double").alias("x"), ((F.col("label") + F.col("id") * 5) % 8).cast("double").alias("y"))


def _matches(spark, sf_dir, radius=2.0):
    found, true = _points(_peaks(spark, sf_dir)), _true(spark, sf_dir)
    return found, true, matching.match_by_cell(found, true, radius)


def _best(peaks: str, keys: str) -> str:
    """Pairs and total distance of every cell's best matching, by trying all ways to give its three points a peak or none."""
    one = f"SELECT {keys}, t.id, p.row * 8 + p.col AS f, sqrt((p.col - t.x) ** 2 + (p.row - t.y) ** 2) AS d FROM pk p JOIN true_points t USING (cell) WHERE sqrt((p.col - t.x) ** 2 + (p.row - t.y) ** 2) <= 2"
    given = lambda i: f"g{i} AS (SELECT {keys}, f, d FROM near WHERE id = {i} UNION ALL SELECT DISTINCT {keys}, -{i + 1}, 0.0 FROM near)"
    return f"""true_points AS MATERIALIZED (SELECT vec_id AS cell, i AS id, (vec_id + i * 3) % 8 AS x, (label + i * 5) % 8 AS y FROM embeddings, (SELECT unnest(range(0, 3)) AS i)),
  pk AS MATERIALIZED ({peaks}), near AS MATERIALIZED ({one}), {given(0)}, {given(1)}, {given(2)},
  ways AS (SELECT {keys}, CAST(g0.f >= 0 AS INT) + CAST(g1.f >= 0 AS INT) + CAST(g2.f >= 0 AS INT) AS n, g0.d + g1.d + g2.d AS d FROM g0 JOIN g1 USING ({keys}) JOIN g2 USING ({keys}) WHERE g0.f <> g1.f AND g0.f <> g2.f AND g1.f <> g2.f),
  best AS (SELECT {keys}, max(n) AS n_match, arg_min(d, {{'a': -n, 'b': d}}) AS total FROM ways GROUP BY {keys})"""


@query(f"WITH {_best(_PEAKS, 'cell')} SELECT cell, n_match, round(total, 6) AS total_d FROM best WHERE n_match > 0")
def peak_matching(spark, sf_dir):
    """Number and total distance of every tile's matches (which of equally good matchings is chosen is open)."""
    return rounded(_matches(spark, sf_dir)[2].groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("n_match"), F.sum("d").alias("total_d")))


@query(f"""WITH {_best(_PEAKS, 'cell')}, c AS (SELECT cell, coalesce(n_found, 0) AS n_found, 3 AS n_true, coalesce(n_match, 0) AS n_match, total / nullif(n_match, 0) AS mean_d
    FROM (SELECT DISTINCT cell FROM true_points) LEFT JOIN (SELECT cell, count(*) AS n_found FROM pk GROUP BY cell) USING (cell) LEFT JOIN best USING (cell)),
  r AS (SELECT *, CASE WHEN n_found > 0 THEN n_match / n_found ELSE 0.0 END AS precision, n_match / n_true AS recall FROM c)
  SELECT cell, n_true, n_found, n_match, round(mean_d, 6) AS mean_d, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1, n_found - n_true AS count_error FROM r""")
def prf1(spark, sf_dir):
    """Precision, recall, F1, mean distance and count error of every tile."""
    found, true, matches = _matches(spark, sf_dir)
    counts = [df.groupBy("cell").agg(F.count(F.lit(1)).alias(n)) for df, n in ((found, "n_found"), (true, "n_true"))]
    hits = matches.groupBy("cell").agg(F.count(F.lit(1)).alias("n_match"), F.avg("d").alias("mean_d"))
    rows = counts[1].join(counts[0], "cell", "left").join(hits, "cell", "left").fillna(0, ["n_found", "n_match"])
    return rounded(evaluation.detection(rows, F.col("n_found"), F.col("n_true")))


THRESHOLDS, RADII = (0.1, 0.15, 0.2, 0.25), (1, 2, 3, 4)
_SWEEP = " UNION ALL ".join(f"SELECT cell, row, col, v, {r} AS radius FROM ({windows(r, extra='a.v AS v, max(b.v) AS hi')}) WHERE v = hi" for r in RADII)
_SETTINGS = f"SELECT cell, row, col, radius, threshold FROM ({_SWEEP}), (SELECT unnest({list(THRESHOLDS)}::DOUBLE[]) AS threshold) WHERE v >= threshold"


@query(f"WITH {_best(_SETTINGS, 'cell, radius, threshold')} SELECT threshold, radius, CAST(sum(n_match) AS BIGINT) AS n_match, round(sum(total) / sum(n_match), 6) AS mean_d FROM best WHERE n_match > 0 GROUP BY threshold, radius")
def readout_sweep(spark, sf_dir):
    """Peaks and matches for thresholds by suppression radii, one row a setting: one window a radius, one matching for all."""
    px, true = roles.pixels(spark, sf_dir), _true(spark, sf_dir)
    levels = F.array(*[F.lit(t) for t in THRESHOLDS])
    found = None
    for radius in RADII:
        peaks = focal.peaks(px, radius, min(THRESHOLDS)).withColumn("threshold", F.explode(F.filter(levels, lambda t: t <= F.col("v"))))
        own = _points(peaks, F.lit(radius).alias("radius"), "threshold")
        found = own if found is None else found.unionByName(own)
    settings = F.explode(F.flatten(F.transform(F.array(*[F.lit(r) for r in RADII]), lambda r: F.transform(levels, lambda t: F.struct(r.alias("radius"), t.alias("threshold"))))))
    named = lambda df: df.withColumn("tile", F.col("cell")).withColumn("cell", F.xxhash64("tile", "radius", "threshold"))
    every = named(true.withColumn("s", settings).select("cell", "id", "x", "y", "s.radius", "s.threshold"))
    matches = matching.match_by_cell(named(found), every, 2.0)
    of = every.select("cell", "radius", "threshold").distinct()
    return rounded(matches.join(of, "cell").groupBy("threshold", "radius").agg(F.count(F.lit(1)).alias("n_match"), F.avg("d").alias("mean_d")))


@query(f"WITH g AS (SELECT l_returnflag AS depth, l_linestatus AS leaf, l_linenumber AS weight, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END) AS pooled FROM lineitem GROUP BY ALL) SELECT depth, leaf, weight, round(pooled, 6) AS pooled FROM g ORDER BY pooled DESC, depth, leaf, weight LIMIT 3")
def top_grid_candidates(spark, sf_dir):
    g = roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("depth"), F.col("l_linestatus").alias("leaf"), F.col("l_linenumber").alias("weight")).agg(F.avg((F.col("l_quantity") > 25).cast("double")).alias("pooled"))
    return rounded(g.orderBy(F.desc("pooled"), "depth", "leaf", "weight").limit(3))


def _ranked(rows, order, n):
    """The first n rows with their rank: a top-n, so only n rows are numbered in one place."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query(f"SELECT *, row_number() OVER (ORDER BY n_dates DESC, n_palms DESC, tile) AS rank FROM (SELECT point % 40 AS tile, count(DISTINCT date) AS n_dates, count(DISTINCT point) AS n_palms FROM ({roles.OBSERVATIONS}) GROUP BY 1) QUALIFY rank <= 10")
def tiles_by_dates_and_palms(spark, sf_dir):
    """Tiles worth a look: most dates first, then most palms."""
    g = roles.observations(spark, sf_dir).groupBy((F.col("point") % 40).alias("tile")).agg(F.count_distinct("date").alias("n_dates"), F.count_distinct("point").alias("n_palms"))
    return _ranked(g, [F.desc("n_dates"), F.desc("n_palms"), F.asc("tile")], 10)


@query(f"SELECT *, row_number() OVER (ORDER BY ndvi_drop, point) AS rank FROM (SELECT point, round(max(ndvi) - min(ndvi), 6) AS ndvi_drop FROM ({roles.OBSERVATIONS}) GROUP BY point) QUALIFY rank <= 20")
def smallest_ndvi_drops(spark, sf_dir):
    """Points in the order of their drop, least first."""
    g = rounded(roles.observations(spark, sf_dir).groupBy("point").agg((F.max("ndvi") - F.min("ndvi")).alias("ndvi_drop")))
    return _ranked(g, [F.asc("ndvi_drop"), F.asc("point")], 20)
