"""Classifiers with location-grouped cross-validation: MLlib, and whole forests or networks a task where the table is small."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.operators import forest, network
from tesselon.operators.evaluation import confusion, pooled
from tesselon.operators.graph import checkpointed

#: Depth that stands for "unlimited" (MLlib allows 30) in a forest; boosted trees have 6.
DEEPEST = 30


def build_model(kind: str, features: Sequence[str], seed: int = 42, **p) -> Pipeline:
    """``kind``: rf, gbt, linear or mlp.  Rows bear a column ``weight``, which mlp, having no weights, ignores."""
    common = {"labelCol": "label", "featuresCol": "features"}
    if kind == "rf":
        stage = RandomForestClassifier(numTrees=p.get("n", 300), maxDepth=p.get("max_depth") or DEEPEST, minInstancesPerNode=p.get("min_leaf", 1), weightCol="weight", seed=seed, **common)
    elif kind == "gbt":
        stage = GBTClassifier(maxIter=p.get("n", 300), maxDepth=p.get("max_depth") or 6, minInstancesPerNode=p.get("min_leaf", 1), weightCol="weight", seed=seed, **common)
    elif kind == "linear":
        stage = LogisticRegression(maxIter=p.get("n", 200), regParam=0.0, weightCol="weight", **common)
    elif kind == "mlp":
        stage = MultilayerPerceptronClassifier(layers=[len(features), p.get("hidden", 32), 2], maxIter=p.get("n", 100), seed=seed, **common)
    else:
        raise ValueError(f"unknown model {kind}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), stage])


def weighted(rows: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Adds weight: positives weigh negatives over positives (one positive at least) times the multiplier."""
    n = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    pos = n["n"] / max(n["p"], 1) * multiplier
    return rows.withColumn("weight", F.when(F.col("label") == 1, pos).otherwise(1.0))


def grouped_cv(rows: DataFrame, features: Sequence[str], kind: str, fold: str = "fold", multiplier: float = 1.0, seed: int = 42, parallelism: int = 4, **p) -> tuple[DataFrame, list[PipelineModel]]:
    """Leave one group out: the confusion of each fold, and the folds' models.

    The loop is over folds, each a distributed fit on the cached rows, ``parallelism`` of them at a
    time; nothing is collected but the list of folds.
    """
    rows = rows.select(*features, "label", F.col(fold).alias("fold")).cache()
    folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]

    def fit(f) -> tuple[PipelineModel, DataFrame]:
        train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        model = build_model(kind, features, seed, **p).fit(weighted(train, multiplier))
        return model, confusion(model.transform(test), ["fold"], F.col("label"), F.col("prediction").cast("int"))

    with ThreadPool(max(1, min(parallelism, len(folds)))) as pool:
        fitted = pool.map(inheritable_thread_target(rows.sparkSession)(fit), folds)
    out = fitted[0][1]
    for _, found in fitted[1:]:
        out = out.unionByName(found)
    out = checkpointed(out)
    rows.unpersist()
    return out, [m for m, _ in fitted]


def mlp_cv(rows: DataFrame, features: Sequence[str], fold: str = "fold", seed: int = 42, n: int = 100, hidden: int = 32) -> DataFrame:
    """Confusion of each fold by networks of the other folds: a whole fit a task where the table is small, else MLlib's."""
    if not network.is_small(rows, features):
        return grouped_cv(rows, features, "mlp", fold, seed=seed, n=n, hidden=hidden)[0]
    right = F.col("true_pos") + F.col("true_neg")
    return network.cross_validated(rows, features, hidden, n, fold, seed).withColumn("accuracy", right / (right + F.col("false_pos") + F.col("false_neg")))


def forest_cv(rows: DataFrame, features: Sequence[str], settings: Sequence[dict], fold: str = "fold", importance: bool = False, kind: str = "rf") -> DataFrame:
    """Confusion and accuracy of each setting (n, max_depth, min_leaf, multiplier, seed) and fold of a small table; ``kind``: rf or gbt."""
    usual = {"n": 300, "max_depth": None, "min_leaf": 1, "multiplier": 1.0, "seed": 42}
    given = [usual | s for s in settings]
    table = [(i, s["n"], s["max_depth"], s["min_leaf"], float(s["multiplier"]), s["seed"]) for i, s in enumerate(given)]
    table = rows.sparkSession.createDataFrame(table, "setting long, trees int, max_depth int, min_leaf int, multiplier double, seed int")
    out = forest.cross_validated(rows, features, table, fold, importance, kind)
    right = F.col("true_pos") + F.col("true_neg")
    return out.withColumn("accuracy", right / (right + F.col("false_pos") + F.col("false_neg")))


def forest_importances(runs: DataFrame, features: Sequence[str], top: int = 15) -> DataFrame:
    """Mean importance over the folds of ``forest_cv``, greatest first."""
    named = runs.select(F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("gains").alias("importance"))).alias("p")).select("p.*")
    return named.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)


def grid_search(rows: DataFrame, features: Sequence[str], kind: str, grid: dict[str, Sequence], multipliers: Sequence[float] = (1.0,), seed: int = 42, **fixed) -> DataFrame:
    """Pooled accuracy and its deviation over folds for every setting, best first."""
    spark, found = rows.sparkSession, []
    schema = ", ".join([*(f"{k} double" for k in grid), "class_weight_multiplier double", "pooled_accuracy double", "fold_accuracy_std double"])
    best_first = (F.desc("pooled_accuracy"), F.asc("fold_accuracy_std"), *(F.asc_nulls_last(k) for k in grid), F.asc("class_weight_multiplier"))
    if kind == "rf" and forest.is_small(rows, features):
        tried = [dict(zip(grid, values, strict=True)) | {"multiplier": m} for values in product(*grid.values()) for m in multipliers]
        runs = forest_cv(rows, features, [{"seed": seed} | fixed | s for s in tried])
        means = runs.groupBy("setting").agg((F.sum(F.col("true_pos") + F.col("true_neg")) / F.sum(F.col("true_pos") + F.col("true_neg") + F.col("false_pos") + F.col("false_neg"))).alias("pooled_accuracy"), F.stddev_pop("accuracy").alias("fold_accuracy_std"))
        named = spark.createDataFrame([(i, *[None if s[k] is None else float(s[k]) for k in grid], float(s["multiplier"])) for i, s in enumerate(tried)], "setting long, " + schema.split(", pooled")[0])
        return named.join(means, "setting").drop("setting").orderBy(*best_first)
    for values in product(*grid.values()):
        setting = dict(zip(grid, values, strict=True))
        for m in multipliers:
            row = pooled(grouped_cv(rows, features, kind, multiplier=m, seed=seed, **fixed, **setting)[0]).first()
            found.append((*[None if v is None else float(v) for v in values], float(m), float(row["pooled_accuracy"]), float(row["fold_accuracy_std"])))
    return spark.createDataFrame(found, schema).orderBy(*best_first)


def seed_runs(rows: DataFrame, features: Sequence[str], kind: str, seeds: Sequence[int], settings: Sequence[dict]) -> tuple[list[dict], DataFrame] | None:
    """All settings over all seeds in one run, as forests of one seed are grown together: for ``seed_stability`` of each; None for larger tables."""
    if kind != "rf" or not forest.is_small(rows, features):
        return None
    tried = [s | {"seed": seed} for s in settings for seed in seeds]
    return tried, checkpointed(forest_cv(rows, features, tried))


def seed_stability(rows: DataFrame, features: Sequence[str], kind: str, seeds: Sequence[int], runs: tuple[list[dict], DataFrame] | None = None, **p) -> DataFrame:
    """Mean and deviation of the pooled accuracy over model seeds; the folds stay.  ``runs``: those of ``seed_runs``, if the setting is among them."""
    spark = rows.sparkSession
    if runs is not None or kind == "rf" and forest.is_small(rows, features):
        own = [p | {"seed": s} for s in seeds]
        tried, found = runs or (own, forest_cv(rows, features, own))
        runs = found.filter(F.col("setting").isin([tried.index(s) for s in own])).groupBy("setting")
        runs = runs.agg((F.sum(F.col("true_pos") + F.col("true_neg")) / F.sum(F.col("true_pos") + F.col("true_neg") + F.col("false_pos") + F.col("false_neg"))).alias("pooled_accuracy"))
        return runs.agg(F.avg("pooled_accuracy").alias("mean"), F.stddev_pop("pooled_accuracy").alias("std"), F.count(F.lit(1)).alias("seeds"))
    found = [(s, float(pooled(grouped_cv(rows, features, kind, seed=s, **p)[0]).first()["pooled_accuracy"])) for s in seeds]
    runs = spark.createDataFrame(found, "seed int, pooled_accuracy double")
    return runs.agg(F.avg("pooled_accuracy").alias("mean"), F.stddev_pop("pooled_accuracy").alias("std"), F.count(F.lit(1)).alias("seeds"))


def importances(spark, models: Sequence[PipelineModel], features: Sequence[str], top: int = 15) -> DataFrame:
    """Mean importance over folds, greatest first."""
    rows = [(n, float(v)) for m in models for n, v in zip(features, m.stages[-1].featureImportances.toArray(), strict=True)]
    out = spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.avg("importance").alias("importance"))
    return out.orderBy(F.desc("importance"), "feature").limit(top)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds prob, the probability of the positive class; the model's features must all be there."""
    missing = [c for c in model.stages[0].getInputCols() if c not in rows.columns]
    if missing:
        raise ValueError(f"rows lack the model's features {missing}")
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str, **about) -> None:
    """The model and what describes it (features, statistics, settings), replacing what is there."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string").write.mode("overwrite").json(f"{path}/about")


def load(path: str) -> tuple[PipelineModel, dict]:
    about = SparkSession.active().read.schema("about string").json(f"{path}/about").first()["about"]
    return PipelineModel.load(f"{path}/model"), json.loads(about)


def dense_predict(model: PipelineModel, px: DataFrame, valid) -> DataFrame:
    """cell, row, col and prob of every pixel; null where it isn't valid."""
    on = ["cell", "row", "col"]
    return px.select(*on).join(score(model, px.filter(valid)).select(*on, "prob"), on, "left")
