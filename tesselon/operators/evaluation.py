"""Scores against labels: counts, curves, summaries and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, by: Sequence[str], label: Column, predicted: Column) -> DataFrame:
    """True and false positives and negatives, and accuracy, of each group."""
    hit = lambda a, b: F.count_if((label == a) & (predicted == b))
    out = rows.groupBy(*by).agg(hit(1, 1).alias("true_pos"), hit(0, 0).alias("true_neg"), hit(0, 1).alias("false_pos"), hit(1, 0).alias("false_neg"))
    return out.withColumn("accuracy", (F.col("true_pos") + F.col("true_neg")) / (F.col("true_pos") + F.col("true_neg") + F.col("false_pos") + F.col("false_neg")))


def pooled(folds: DataFrame) -> DataFrame:
    """Accuracy over all rows, its mean over folds and its population deviation."""
    right, wrong = F.sum(F.col("true_pos") + F.col("true_neg")), F.sum(F.col("false_pos") + F.col("false_neg"))
    return folds.agg((right / (right + wrong)).alias("pooled_accuracy"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("fold_accuracy_std"))


def summary(rows: DataFrame, score: str, key: str) -> DataFrame:
    p = F.col(score)
    return rows.agg(F.avg(p).alias("mean"), F.expr(f"percentile({score}, 0.5)").alias("median"), F.stddev_pop(p).alias("std"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.count_distinct(key).alias("keys"), F.count_if(p > 0.5).alias("positive"))


def histogram(rows: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """Equal bins on [0, 1], the last closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def tails(rows: DataFrame, score: str, thresholds: Sequence[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(score) > t).alias(f"over_{round(t * 100)}") for t in thresholds])


def quantiles(rows: DataFrame, score: str, at: Sequence[float]) -> DataFrame:
    """Linear interpolation between order statistics, as numpy does."""
    found = F.expr(f"percentile({score}, array({', '.join(map(str, at))}))")
    row = rows.agg(found.alias("q"), F.avg((F.col(score) >= 0.5).cast("int")).alias("share"))
    return row.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(a)) for a in at]).alias("p"), F.col("q"))).alias("p", "value"), "share")


def roc_auc(rows: DataFrame, by: Sequence[str], label: Column, score: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks, also folded to at least one half; null with one class only."""
    w = Window.partitionBy(*by).orderBy(score)
    ranked = rows.withColumn("_y", label).withColumn("_r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2)
    pos, neg = F.sum("_y"), F.count(F.lit(1)) - F.sum("_y")
    out = ranked.groupBy(*by).agg(((F.sum(F.when(F.col("_y") == 1, F.col("_r"))) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"))
    return out.withColumn("folded", F.greatest("auc", 1 - F.col("auc")))


def class_weights(rows: DataFrame, label: Column, multiplier: float = 1.0) -> DataFrame:
    """Weight of the positive class: negatives over positives; without positives one is assumed."""
    pos, neg = F.count_if(label == 1), F.count_if(label == 0)
    return rows.agg(pos.alias("n_pos"), neg.alias("n_neg"), (neg / F.greatest(pos, F.lit(1)) * multiplier).alias("pos_weight"))


def detection(matches: DataFrame, n_found: Column, n_true: Column) -> DataFrame:
    """Precision, recall, F1, mean distance and count error of matched detections: one row a group."""
    precision = F.when(n_found > 0, F.col("n_match") / n_found).otherwise(0.0)
    recall = F.when(n_true > 0, F.col("n_match") / n_true).otherwise(0.0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return matches.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1).withColumn("count_error", n_found - n_true)


def sharpness_ranking(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, deviation and percent behind the sharpest, sharpest first."""
    out = rows.groupBy(by).agg(F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.stddev_pop(value).alias("std"))
    best = out.agg(F.max("mean").alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("gap", (F.col("best") - F.col("mean")) / F.col("best") * 100).drop("best").orderBy(F.desc("mean"), by)  # one row
