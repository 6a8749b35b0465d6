"""Statistics over the dates of a location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stability(rows: DataFrame, by: Sequence[str], values: Sequence[str], valid: Column | None = None, ddof: int = 0) -> DataFrame:
    """Standard deviation and range of each value over dates, and how many dates count; 0 where undefined."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    own = lambda v: F.when(valid, F.col(v)) if valid is not None else F.col(v)
    aggregates = []
    for v in values:
        aggregates += [F.coalesce(std(own(v)), F.lit(0.0)).alias(f"{v}_std"), F.coalesce(F.max(own(v)) - F.min(own(v)), F.lit(0.0)).alias(f"{v}_range")]
    return rows.groupBy(*by).agg(*aggregates, F.count(own(values[0])).alias("n_dates"))


def with_stability(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The same, added to every row by one window (one shuffle, no join back)."""
    w = Window.partitionBy(*by)
    out = {}
    for v in values:
        out |= {f"{v}_std": F.coalesce(F.stddev_pop(v).over(w), F.lit(0.0)), f"{v}_range": F.coalesce(F.max(v).over(w) - F.min(v).over(w), F.lit(0.0))}
    return rows.withColumns(out | {"n_dates": F.count(values[0]).over(w)})


def pair_dates(rows: DataFrame, first, second, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of two dates side by side for the keys that both have."""
    a = rows.filter(F.col("date") == first).select(*on, *[F.col(v).alias(f"{v}_a") for v in values])
    b = rows.filter(F.col("date") == second).select(*on, *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, list(on))


def cells_in_all_dates(rows: DataFrame, n_dates: int) -> DataFrame:
    return rows.groupBy("cell").agg(F.count_distinct("date").alias("n")).filter(F.col("n") == n_dates).select("cell")


def sweep(rows: DataFrame, value: str, thresholds: Sequence[float], keep: Column | None = None) -> DataFrame:
    """How many rows reach each threshold, in one pass."""
    hit = lambda t: F.count_if((F.col(value) >= t) & keep) if keep is not None else F.count_if(F.col(value) >= t)
    counts = rows.agg(*[hit(t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])))


def harvest(pairs: DataFrame, drop_least: float, canopy_least: float, green_least: float, per_tile: int, seed: str = "7") -> DataFrame:
    """Pixels that lose greenness between dates, at most ``per_tile`` a cell, drawn by a hash of their place."""
    drop = F.col("ndvi_b") - F.col("ndvi_a")
    kept = pairs.withColumn("drop", drop).filter((F.col("chm_b") >= canopy_least) & (F.col("ndvi_b") >= green_least) & (F.col("drop") >= drop_least))
    return capped(kept, ["cell"], F.concat_ws("_", F.lit(seed), "cell", "row", "col"), per_tile)


def capped(rows: DataFrame, by: Sequence[str], name: Column, k: int) -> DataFrame:
    """At most k rows a group in the order of md5 of their names: a draw that any engine repeats."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(name.cast("binary")), name))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
