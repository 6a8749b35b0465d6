"""Dates of a place: newest valid value, stability, harvest and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import spectral
from tesselon.operators import raster, temporal
from tesselon.plans import roles
from tesselon.plans.roles import BANDS, OBSERVATIONS, SPARSE, rounded

query = roles.Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"SELECT cell, row, col, date, round(q, 6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY cell, row, col ORDER BY date DESC) AS n FROM ({SPARSE}) WHERE q <> 0 OR p <> 0) WHERE n = 1")
def newest_valid_date(spark, sf_dir):
    return rounded(raster.newest(roles.sparse(spark, sf_dir), ["cell", "row", "col"], "date", "q", "p").select("cell", "row", "col", "date", "q"))


@query(f"SELECT point, round(stddev_pop(ndvi), 6) AS ndvi_std, round(max(ndvi) - min(ndvi), 6) AS ndvi_range, round(stddev_pop(chm), 6) AS chm_std, round(max(chm) - min(chm), 6) AS chm_range, count(ndvi) AS n_dates FROM ({OBSERVATIONS}) GROUP BY point")
def temporal_stability(spark, sf_dir):
    return rounded(temporal.stability(roles.observations(spark, sf_dir), ["point"], ["ndvi", "chm"]))


@query(f"SELECT event_id, point, round(stddev_pop(ndvi) OVER w, 6) AS ndvi_std, round(max(ndvi) OVER w - min(ndvi) OVER w, 6) AS ndvi_range, count(*) OVER w AS n_dates FROM ({OBSERVATIONS}) WINDOW w AS (PARTITION BY point)")
def temporal_merge_back(spark, sf_dir):
    return rounded(temporal.with_stability(roles.observations(spark, sf_dir), ["point"], ["ndvi"]).select("event_id", "point", "ndvi_std", "ndvi_range", "n_dates"))


def _dense(ddof: int):
    std = "stddev_pop" if ddof == 0 else "stddev_samp"
    sql = f"SELECT cell, row, col, round(coalesce({std}(q) FILTER (q <> 0 OR p <> 0), 0), 6) AS q_std, round(coalesce(max(q) FILTER (q <> 0 OR p <> 0) - min(q) FILTER (q <> 0 OR p <> 0), 0), 6) AS q_range, count(q) FILTER (q <> 0 OR p <> 0) AS n_dates FROM ({SPARSE}) GROUP BY cell, row, col"

    def run(spark, sf_dir):
        valid = spectral.is_valid(F.col("q"), F.col("p"))
        return rounded(temporal.stability(roles.sparse(spark, sf_dir), ["cell", "row", "col"], ["q"], valid, ddof))

    run.__name__ = f"dense_temporal_ddof{ddof}"
    return query(sql)(run)


for _d in (0, 1):
    _dense(_d)


@query(f"SELECT row, col, count(DISTINCT cell) AS coverage FROM ({SPARSE}) WHERE q <> 0 OR p <> 0 GROUP BY row, col")
def coverage_count(spark, sf_dir):
    valid = roles.sparse(spark, sf_dir).filter(spectral.is_valid(F.col("q"), F.col("p")))
    return valid.groupBy("row", "col").agg(F.count_distinct("cell").alias("coverage"))


_PAIRS = f"SELECT cell, a.row AS row, a.col AS col, (a.nir - a.red) / (a.nir + a.red + 1e-6) AS ndvi_a, (b.nir - b.red) / (b.nir + b.red + 1e-6) AS ndvi_b, b.chm AS chm_b, a.nir + a.red AS bright FROM ({BANDS}) a JOIN ({BANDS}) b USING (cell, row, col) WHERE a.date = 0 AND b.date = 1"


def _pairs(spark, sf_dir):
    b = roles.bands(spark, sf_dir).withColumn("ndvi", spectral.ndvi(F.col("nir"), F.col("red"))).withColumn("bright", F.col("nir") + F.col("red"))
    return temporal.pair_dates(b, 0, 1, ["cell", "row", "col"], ["ndvi", "chm", "bright"])


@query(f"""SELECT cell, row, col, round(ndvi_b - ndvi_a, 6) AS drop FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5('7_' || cell || '_' || row || '_' || col), '7_' || cell || '_' || row || '_' || col) AS n
  FROM ({_PAIRS}) WHERE chm_b >= 0.5 AND ndvi_b >= 0.1 AND ndvi_b - ndvi_a >= 0.2) WHERE n <= 2""")
def ndvi_drop_harvest(spark, sf_dir):
    return rounded(temporal.harvest(_pairs(spark, sf_dir), 0.2, 0.5, 0.1, 2).select("cell", "row", "col", "drop"))


@query(f"SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (chm_b >= 0.5 AND ndvi_b - ndvi_a >= t) AS n FROM ({_PAIRS}), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS t) GROUP BY t")
def threshold_sweep(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("drop", F.col("ndvi_b") - F.col("ndvi_a"))
    return temporal.sweep(p, "drop", [0.1, 0.2, 0.3, 0.4, 0.5], F.col("chm_b") >= 0.5)


@query(f"""WITH p AS (SELECT *, avg(bright) OVER (PARTITION BY cell) AS around FROM ({_PAIRS}))
  SELECT count(*) FILTER (ndvi_b - ndvi_a >= 0.2) AS before, count(*) FILTER (ndvi_b - ndvi_a >= 0.2 AND bright / around >= 0.6) AS after, count(*) FILTER (ndvi_b - ndvi_a >= 0.2 AND bright / around < 0.6) AS shadowed FROM p""")
def shadow_gate_impact(spark, sf_dir):
    from pyspark.sql import Window

    p = _pairs(spark, sf_dir).withColumn("ratio", F.col("bright_a") / F.avg("bright_a").over(Window.partitionBy("cell")))
    hit = F.col("ndvi_b") - F.col("ndvi_a") >= 0.2
    return p.agg(F.count_if(hit).alias("before"), F.count_if(hit & (F.col("ratio") >= 0.6)).alias("after"), F.count_if(hit & (F.col("ratio") < 0.6)).alias("shadowed"))
