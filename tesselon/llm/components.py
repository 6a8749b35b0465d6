"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import cluster


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (least id reachable) of every id in ``edges`` (a, b).

    Each round takes the least label among a vertex and its neighbours and then the label of that
    label (pointer jumping), so chains of n links need about log n rounds.  Labels stay in tables.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = cluster.stored(both, "edges")
    labels = cluster.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    while True:
        jump = labels.select(F.col("a").alias("t"), F.col("c").alias("jc"))
        near = both.join(labels.select(F.col("a").alias("b"), F.col("c").alias("bc")), "b").groupBy("a").agg(F.min("bc").alias("m"))
        step = labels.join(near, "a").select("a", "c", F.least("c", "m").alias("m"))
        step = step.join(jump, F.col("m") == F.col("t"), "left").select("a", F.least("m", F.coalesce("jc", "m")).alias("c"), F.col("c").alias("was"))
        step = cluster.stored(step, "labels")
        changed = step.filter("c <> was").limit(1).count()
        labels = step.select("a", "c")
        if not changed:
            return labels.select(F.col("a").alias("id"), F.col("c").alias("component"))
