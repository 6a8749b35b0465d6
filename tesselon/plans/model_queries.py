"""Feature tables, cross-validation, search and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import evaluation, features, models, sampling
from tesselon.plans import roles
from tesselon.plans.raster_queries import windows
from tesselon.plans.roles import rounded

query = roles.Registry()
QUERIES, SQL = query.queries, query.sql

DIMENSIONS = 64
FEATURES = [f"f{i}" for i in range(DIMENSIONS)]
#: The reference's grid for forests (None: unlimited), class weights, trees, and seeds of the best settings.
GRID = {"max_depth": (3, 5, 8, None), "min_leaf": (1, 2, 5, 10)}
MULTIPLIERS = (0.5, 1.0, 1.5)
TREES, SEEDS, BEST = 300, (1, 2, 3, 4, 5), 3


LOCATIONS = 10


def labelled(spark, sf_dir):
    """embeddings as a feature table: 64 features, a binary label, and folds by location: a tile's positives, negatives dealt."""
    e = roles.table(spark, sf_dir, "embeddings")
    columns = [F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)]
    rows = e.select("vec_id", *columns, (F.col("label") >= 5).cast("int").alias("label"))
    return sampling.location_folds(rows, F.col("vec_id") % LOCATIONS, F.concat_ws("_", F.lit("5"), "vec_id"))


@query(f"""WITH r AS (SELECT vec_id, vec_id % {LOCATIONS} AS tile, label >= 5 AS positive FROM embeddings), n AS (SELECT count(DISTINCT tile) AS n FROM r WHERE positive)
  SELECT vec_id, CAST(dense_rank() OVER (ORDER BY tile) - 1 AS BIGINT) AS fold FROM r WHERE positive
  UNION ALL SELECT vec_id, CAST((row_number() OVER (ORDER BY md5('5_' || vec_id), '5_' || vec_id) - 1) % greatest(n, 1) AS BIGINT) FROM r, n WHERE NOT positive""")
def location_folds(spark, sf_dir):
    return labelled(spark, sf_dir).select("vec_id", "fold")


_W = {r: windows(r, extra=f"a.v AS v, avg(b.v) AS m{r}, stddev_pop(b.v) AS s{r}, max(b.v) AS x{r}, min(b.v) AS n{r}") for r in (1, 2)}


@query(f"""WITH w1 AS ({_W[1]}), w2 AS ({_W[2]}), p AS (SELECT vec_id AS cell, vec_id % 8 AS row, label % 8 AS col, CAST(label >= 5 AS INT) AS label FROM embeddings)
  SELECT cell, label, round(w1.v, 6) AS v_point, round(m1, 6) AS v_mean_1, round(s1, 6) AS v_std_1, round(x1, 6) AS v_max_1, round(n1, 6) AS v_min_1, round(m2, 6) AS v_mean_2, round(s2, 6) AS v_std_2, round(x2, 6) AS v_max_2, round(n2, 6) AS v_min_2, round(w1.v - m2, 6) AS v_contrast
  FROM p JOIN w1 USING (cell, row, col) JOIN w2 USING (cell, row, col)""")
def point_features(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("cell"), (F.col("vec_id") % 8).cast("int").alias("row"), (F.col("label") % 8).cast("int").alias("col"), (F.col("label") >= 5).cast("int").alias("label"))
    out = features.point_table(roles.pixels(spark, sf_dir), points, (1, 2), shape=False)
    return rounded(out.drop("row", "col"))


@query()
def feature_table(spark, sf_dir):
    """All window features of two radii at one point a tile, with temporal features of its cell."""
    e = roles.table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("cell"), (F.col("vec_id") % 8).cast("int").alias("row"), (F.col("label") % 8).cast("int").alias("col"), (F.col("label") >= 5).cast("int").alias("label"))
    out = features.point_table(roles.pixels(spark, sf_dir), points, (1, 2))
    from tesselon.operators.temporal import with_stability

    return rounded(with_stability(out.withColumn("place", F.floor(F.col("cell") / 3)), ["place"], ["v_point"]))


def _cv(kind: str, name: str, **p):
    def run(spark, sf_dir):
        return rounded(models.grouped_cv(labelled(spark, sf_dir), FEATURES, kind, **p)[0])

    run.__name__ = name
    return query()(run)


@query()
def rf_loto_cv(spark, sf_dir):
    runs = models.forest_cv(labelled(spark, sf_dir), FEATURES, [{"n": TREES}])
    return rounded(runs.select("fold", "true_pos", "true_neg", "false_pos", "false_neg", "accuracy"))


@query()
def gbt_loto_cv(spark, sf_dir):
    runs = models.forest_cv(labelled(spark, sf_dir), FEATURES, [{"n": TREES, "max_depth": 6}], kind="gbt")
    return rounded(runs.select("fold", "true_pos", "true_neg", "false_pos", "false_neg", "accuracy"))


_cv("linear", "linear_probe_cv", n=200)


@query()
def mlp_probe_cv(spark, sf_dir):
    return rounded(models.mlp_cv(labelled(spark, sf_dir), FEATURES, n=200, hidden=32))


@query()
def grid_search(spark, sf_dir):
    return rounded(models.grid_search(labelled(spark, sf_dir), FEATURES, "rf", GRID, MULTIPLIERS, n=TREES))


@query()
def seed_stability(spark, sf_dir):
    """The best settings of the grid, each over all seeds."""
    rows, out, settings = labelled(spark, sf_dir), None, []
    for best in models.grid_search(rows, FEATURES, "rf", GRID, MULTIPLIERS, n=TREES).limit(BEST).collect():
        depth = best["max_depth"]
        settings.append({"n": TREES, "max_depth": None if depth is None else int(depth), "min_leaf": int(best["min_leaf"]), "multiplier": best["class_weight_multiplier"]})
    runs = models.seed_runs(rows, FEATURES, "rf", SEEDS, settings)
    for s in settings:
        depth, leaf, multiplier = s["max_depth"], s["min_leaf"], s["multiplier"]
        found = models.seed_stability(rows, FEATURES, "rf", SEEDS, runs=runs, **s)
        found = found.select(F.lit(depth).cast("double").alias("max_depth"), F.lit(leaf).alias("min_leaf"), F.lit(multiplier).alias("class_weight_multiplier"), "*")
        out = found if out is None else out.unionByName(found)
    return rounded(out)


@query()
def feature_importance(spark, sf_dir):
    runs = models.forest_cv(labelled(spark, sf_dir), FEATURES, [{"n": TREES}], importance=True)
    return rounded(models.forest_importances(runs, FEATURES))


@query()
def production_scoring(spark, sf_dir):
    """A model of all rows, applied to them: the summary of its scores."""
    rows = labelled(spark, sf_dir)
    model = models.build_model("rf", FEATURES, n=TREES, max_depth=8).fit(models.weighted(rows))
    return rounded(evaluation.summary(models.score(model, rows), "prob", "vec_id"))


@query()
def dense_predict(spark, sf_dir):
    """Probability of every valid pixel from its window features."""
    px = features.window_features(roles.pixels(spark, sf_dir), (1,), shape=False)
    names = [c for c in px.columns if c not in ("cell", "row", "col")]
    e = roles.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), (F.col("label") >= 5).cast("int").alias("label"))
    train = px.filter("row = 4 and col = 4").join(e, "cell")
    model = models.build_model("rf", names, n=10, max_depth=4).fit(models.weighted(train))
    return rounded(models.dense_predict(model, px, F.col("v_point") != 0))
