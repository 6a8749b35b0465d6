"""Role views: which of the driver's tables stands in for which input, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.operators import raster

# The tile grid's origin.
X0, Y0 = 2715098.0, 1120181.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 single-band tiles: cell, row, col, v."""
    return raster.from_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


PIXELS = "SELECT vec_id AS cell, (i - 1) // 8 AS row, (i - 1) % 8 AS col, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 4 x 8 tiles of three dates: cell, date, row, col, nir, red, chm, made positive."""
    e = table(spark, sf_dir, "embeddings")
    halves = F.arrays_zip(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    out = e.select(F.floor(F.col("vec_id") / 3).alias("cell"), (F.col("vec_id") % 3).alias("date"), F.posexplode(halves).alias("p", "h"))
    a, b = F.col("h.a").cast("double"), F.col("h.b").cast("double")
    return out.select(
        "cell",
        "date",
        F.floor(F.col("p") / 8).cast("int").alias("row"),
        (F.col("p") % 8).cast("int").alias("col"),
        F.abs(a).alias("nir"),
        F.abs(b).alias("red"),
        F.greatest((a - b) * 10, F.lit(0.0)).alias("chm"),
    )


BANDS = """SELECT vec_id // 3 AS cell, vec_id % 3 AS date, i // 8 AS row, i % 8 AS col, abs(CAST(embedding[i + 1] AS DOUBLE)) AS nir,
  abs(CAST(embedding[i + 33] AS DOUBLE)) AS red, greatest((CAST(embedding[i + 1] AS DOUBLE) - CAST(embedding[i + 33] AS DOUBLE)) * 10, 0) AS chm
  FROM embeddings, (SELECT unnest(range(0, 32)) AS i)"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as sparse 64 x 64 tiles of three dates: cell, date, row, col, q, p, d; collisions are averaged."""
    rows = table(spark, sf_dir, "lineitem")
    place = [(F.col("l_suppkey") % 4).alias("cell"), F.col("l_returnflag").alias("date"), (F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")]
    out = rows.groupBy(*place).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"))
    return out.withColumn("q", F.when(F.col("q") > 45, 0.0).otherwise(F.col("q"))).withColumn("p", F.when(F.col("q") == 0, 0.0).otherwise(F.col("p")))


SPARSE = """SELECT cell, date, row, col, q, CASE WHEN q = 0 THEN 0 ELSE p END AS p, d FROM (
  SELECT cell, date, row, col, CASE WHEN q > 45 THEN 0 ELSE q END AS q, p, d FROM (
    SELECT l_suppkey % 4 AS cell, l_returnflag AS date, l_orderkey % 64 AS row, l_partkey % 64 AS col, avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_discount) AS d
    FROM lineitem GROUP BY ALL))"""


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """customer, supplier or part as points: id, x, y on a 0.1 m lattice of 2 km."""
    key, a, b = {"customer": ("c_custkey", 7919, 104729), "supplier": ("s_suppkey", 6007, 30011), "part": ("p_partkey", 5003, 12007)}[name]
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("id"), (X0 + (k * a % 20000) / F.lit(10.0)).alias("x"), (Y0 - (k * b % 20000) / F.lit(10.0)).alias("y"))


def points_sql(name: str) -> str:
    key, a, b = {"customer": ("c_custkey", 7919, 104729), "supplier": ("s_suppkey", 6007, 30011), "part": ("p_partkey", 5003, 12007)}[name]
    return f"SELECT {key} AS id, {X0}::DOUBLE + ({key} * {a} % 20000) / 10.0::DOUBLE AS x, {Y0}::DOUBLE - ({key} * {b} % 20000) / 10.0::DOUBLE AS y FROM {name}"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dated observations of points: point, date, kind, ndvi, chm."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("point"), F.to_date("ts").alias("date"), F.col("event_type").alias("kind"), (F.col("value") / 500).alias("ndvi"), (F.col("value") % 7).alias("chm"), "event_id")


OBSERVATIONS = "SELECT user_id AS point, CAST(ts AS DATE) AS date, event_type AS kind, value / 500 AS ndvi, value % 7 AS chm, event_id FROM events"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as scored candidates: id, tile, prob in [0, 1], and a label."""
    o = table(spark, sf_dir, "orders")
    prob = F.least(F.col("o_totalprice") / 500000, F.lit(1.0))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), F.col("o_custkey") % 20).alias("tile"), prob.alias("prob"), (F.col("o_orderpriority").substr(1, 1).cast("int") <= 2).cast("int").alias("label"), "o_custkey")


CANDIDATES = """SELECT o_orderkey AS id, 't' || (o_custkey % 20) AS tile, least(o_totalprice / 500000, 1.0) AS prob,
  CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) <= 2 AS INT) AS label, o_custkey FROM orders"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def unsigned_zeros(sql: str) -> str:
    """SQL whose round(...) calls give no negative zeros either."""
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        depth, end = 0, found + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out += [sql[at:found], "(", sql[found:end], " + 0.0)"]
        at = end
    return "".join(out) + sql[at:]


class Registry:
    """Decorator that keeps a module's queries and their SQL."""

    def __init__(self) -> None:
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = unsigned_zeros(sql)
            return f

        return register
