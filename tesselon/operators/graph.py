"""Connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that spark.checkpoint.dir names (a temporary one only on a single machine, as in tests)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tesselon-"))
    return df.checkpoint()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that edges (a, b) connect each vertex with.

    Least-neighbour labels with pointer jumping: about log n rounds of three equi-joins.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = checkpointed(both)
    labels = checkpointed(vertices.select(F.col("id").alias("a"), F.col("id").alias("c")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("c").alias("bc")), "b").groupBy("a").agg(F.min("bc").alias("m"))
        jump = labels.select(F.col("a").alias("t"), F.col("c").alias("jc"))
        step = labels.join(near, "a", "left").select("a", "c", F.least("c", F.coalesce("m", "c")).alias("m"))
        step = checkpointed(step.join(jump, F.col("m") == F.col("t"), "left").select("a", F.least("m", F.coalesce("jc", "m")).alias("c"), F.col("c").alias("was")))
        changed = step.filter("c <> was").limit(1).count()
        labels = step.select("a", "c")
        if not changed:
            return labels.select(F.col("a").alias("id"), F.col("c").alias("component"))
