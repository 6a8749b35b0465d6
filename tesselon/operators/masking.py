"""Self-supervised primitives: patches, random masks, masked loss and the learning-rate schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators.sampling import draw


def patchify(px: DataFrame, size: int, width: int) -> DataFrame:
    """Adds patch (row-major) and token (place in the patch)."""
    across = width // size
    patch = F.floor(F.col("row") / size) * across + F.floor(F.col("col") / size)
    return px.withColumns({"patch": patch.cast("int"), "token": ((F.col("row") % size) * size + F.col("col") % size).cast("int")})


def unpatchify(tokens: DataFrame, size: int, width: int) -> DataFrame:
    across = width // size
    row = F.floor(F.col("patch") / across) * size + F.floor(F.col("token") / size)
    return tokens.withColumns({"row": row.cast("int"), "col": ((F.col("patch") % across) * size + F.col("token") % size).cast("int")}).drop("patch", "token")


def random_mask(patches: DataFrame, n: int, ratio: float, seed: str) -> DataFrame:
    """Adds masked and restore (place in the shuffled order); int((1 - ratio) * n) patches stay visible."""
    keep = int((1 - ratio) * n)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(draw(F.concat_ws("_", F.lit(seed), "cell", "patch")), "patch"))
    return patches.withColumn("restore", rank - 1).withColumn("masked", (F.col("restore") >= keep).cast("int"))


def masked_mse(tokens: DataFrame, value: str, predicted: str) -> DataFrame:
    """Mean square error of masked patches: the mean over tokens, then over patches."""
    error = (F.col(predicted) - F.col(value)) * (F.col(predicted) - F.col(value))
    of_patch = tokens.filter("masked = 1").groupBy("cell", "patch").agg(F.avg(error).alias("loss"))
    return of_patch.groupBy("cell").agg(F.avg("loss").alias("loss"))


def learning_rate(epoch: Column, warmup: float, total: float, base: float, least: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine."""
    cosine = least + (base - least) * 0.5 * (1 + F.cos(math.pi * (epoch - warmup) / (total - warmup)))
    return F.when(epoch < warmup, base * epoch / warmup).otherwise(cosine)
