"""Seeded samples and splits: order by md5 of a name, so that any engine draws the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(name: Column) -> Column:
    return F.md5(name.cast("binary"))


def subsample(rows: DataFrame, name: Column, n: int) -> DataFrame:
    """n rows without replacement (a top-n by hash: each task keeps n at most)."""
    return rows.withColumn("_o", draw(name)).orderBy("_o").limit(n).drop("_o")


def hashed_rank(rows: DataFrame, by: Sequence[str], name: Column) -> DataFrame:
    """Adds rank, from 0, in the hashed order of each group of ``by``.

    No group is ranked in one task: ranges of the hash are counted first, so that each range ranks its own
    rows and begins where those before it end.
    """
    dealt = rows.withColumn("_name", name).withColumn("_hash", draw(F.col("_name"))).withColumn("_range", F.substring("_hash", 1, 3))
    counts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 a group
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_range").alias("_b_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    on = F.col("_range") == F.col("_b_range")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    rank = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_hash", "_name"))
    own = dealt.join(begins, on).withColumn("rank", F.col("_begin") + rank - 1)
    return own.select(*rows.columns, "rank")


def round_robin(rows: DataFrame, by: Sequence[str], name: Column, folds: int | Column) -> DataFrame:
    """Folds dealt in turn along the hashed order of each group of ``by``."""
    return hashed_rank(rows, by, name).withColumn("fold", F.col("rank") % folds).drop("rank")


def location_folds(rows: DataFrame, tile: Column, name: Column, label: str = "label") -> DataFrame:
    """Adds fold: one for each tile that has positives, in order of the tiles; negatives are dealt over the folds in turn.

    Only the tiles with positives, few beside rows, are ranked in one place.  Without positives all folds are 0.
    """
    named = rows.withColumn("_tile", tile)
    tiles = named.filter(F.col(label) == 1).select(F.col("_tile").alias("_t")).distinct()
    tiles = tiles.select("_t", (F.row_number().over(Window.orderBy("_t")) - 1).cast("long").alias("fold"))
    n = max(tiles.count(), 1)
    positives = named.filter(F.col(label) == 1).join(tiles, F.col("_tile") == F.col("_t")).select(*rows.columns, "fold")
    return positives.unionByName(round_robin(rows.filter(F.col(label) != 1), [label], name, n).withColumn("fold", F.col("fold").cast("long")))


def spatial_blocks(rows: DataFrame, block: float, val: float, test: float, seed: str) -> DataFrame:
    """Rows with the split of their block: blocks in hashed order, floor(n * share) of them to val and test.

    Blocks are few beside rows: only they are ranked in one place.
    """
    named = rows.withColumns({"bx": F.floor(F.col("x") / block), "by": F.floor(F.col("y") / block)})
    blocks = named.select("bx", "by").distinct()
    rank = F.row_number().over(Window.orderBy(draw(F.concat_ws("_", F.lit(seed), "bx", "by")), "bx", "by"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = blocks.withColumn("i", rank - 1).withColumn("n", n)
    v, t = F.floor(F.col("n") * val), F.floor(F.col("n") * test)
    split = F.when(F.col("i") < v, "val").when(F.col("i") < v + t, "test").otherwise("train")
    return named.join(ranked.select("bx", "by", split.alias("split")), ["bx", "by"])


def controls(px: DataFrame, keep: Column, per_tile: int, n: int, seed: str) -> DataFrame:
    """n control pixels that meet ``keep``: at most ``per_tile`` a tile, tiles in hashed order, as a scan tile by tile would find them."""
    from tesselon.operators.temporal import capped

    name = F.concat_ws("_", F.lit(seed), "cell", "row", "col")
    tile = F.md5(F.concat_ws("_", F.lit(seed), "cell").cast("binary"))
    drawn = capped(px.filter(keep), ["cell"], name, per_tile)
    return drawn.orderBy(tile, draw(name)).limit(n)


def even_ranks(n: int, k: int) -> list[int]:
    """Distinct ranks spread evenly over 0 .. n - 1, ties to the even rank."""
    if n <= 0 or k <= 0:
        return []
    if k == 1:
        return [0]
    return sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


def hashed_points(spark, n: int, x0: float, y0: float, x1: float, y1: float, seed: str) -> DataFrame:
    """n points of a box from md5 digits: the same in any engine."""
    digits = lambda a: F.conv(F.substring("_h", a, 8), 16, 10).cast("double") / 4294967296.0
    out = spark.range(n).withColumn("_h", F.md5(F.concat_ws("_", F.lit(seed), F.col("id")).cast("binary")))
    return out.select("id", (F.lit(x0) + digits(1) * (x1 - x0)).alias("x"), (F.lit(y0) + digits(9) * (y1 - y0)).alias("y"))
