"""Label stores: routing, union, deduplication and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators.spatial import near_pairs


def union_layers(*layers: DataFrame) -> DataFrame:
    """All rows of ragged layers; duplicates stay."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def first_wins(rows: DataFrame, digits: int, order: Sequence[Column]) -> DataFrame:
    """Of rows that agree in x and y rounded half-even, the first."""
    key = [F.bround(c, digits) for c in ("x", "y")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def not_done(rows: DataFrame, done: DataFrame, digits: int = 3, also: Sequence[str] = ()) -> DataFrame:
    """Rows whose rounded place (and ``also`` columns, such as the model) isn't among the done ones."""
    keys = lambda df: df.withColumns({"_kx": F.bround("x", digits), "_ky": F.bround("y", digits)})
    on = ["_kx", "_ky", *also]
    return keys(rows).join(keys(done).select(*on).distinct(), on, "left_anti").drop("_kx", "_ky")


def new_points(rows: DataFrame, known: DataFrame, tolerance: float, key: str = "id") -> DataFrame:
    """Rows farther than ``tolerance`` (in the units of x and y) from every known point."""
    close = near_pairs(rows.select(key, "x", "y"), known.select("x", "y"), tolerance, closed=True)
    return rows.join(close.select(key).distinct(), key, "left_anti")


def route_verdicts(rows: DataFrame) -> DataFrame:
    """Reviewed rows as labels: palms at the corrected place, others at the reviewed one; the unsure are left out."""
    palm = F.col("verdict") == "palm"
    kept = rows.filter(F.col("verdict").isin("palm", "not_palm"))
    return kept.withColumns({"label": palm.cast("int"), "x": F.when(palm, F.col("corrected_x")).otherwise(F.col("x")), "y": F.when(palm, F.col("corrected_y")).otherwise(F.col("y"))}).drop("corrected_x", "corrected_y")


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each key the row of the greatest order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).filter("_n = 1").drop("_n")


def classify_footprint(points: DataFrame, cells: DataFrame, first_date: Column) -> DataFrame:
    """Of each point: in the first date's footprint, in another's only, or outside; from its covering cells."""
    flags = points.join(cells, "cell", "left").groupBy("id").agg(F.bool_or(F.coalesce(first_date, F.lit(False))).alias("first"), F.bool_or(F.col("date").isNotNull()).alias("any"))
    return flags.select("id", F.when(F.col("first"), "in_first").when(F.col("any"), "in_other").otherwise("outside").alias("place"))


def prioritised(rows: DataFrame, near_road: float) -> DataFrame:
    """near_road (false without a distance), priority (0 best) and the order of the shortlist."""
    near = F.coalesce(F.col("dist") <= near_road, F.lit(False))
    return rows.withColumn("near_road", near).withColumn("priority", (~near).cast("int") + (~F.col("nir_available")).cast("int"))
