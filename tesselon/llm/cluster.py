"""Where intermediate tables go, and joins that broadcast only what has been measured."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured bytes are at most this; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20


#: Bytes of an Arrow batch.  Rows hold whole texts or packed blobs, so the default, 64 MB, takes hundreds of MB on
#: either side of the Python boundary.
BATCH_BYTES = 2 << 20


#: Bytes of a file up to which Spark may broadcast it unasked.  A compressed table of numbers is many times its file in
#: the driver's hash relation, so of the default, 10 MB, a few joins at once fill a small driver.
AUTO_BROADCAST_BYTES = 256 << 10


def _at_most(spark: SparkSession, key: str, most: int) -> None:
    now = spark.conf.get(key, None)
    number = re.fullmatch(r"(-?\d+)([kKmMgGtT]?)[bB]?", (now or "").strip())
    size = int(number[1]) << (10 * "_kmgt".index(number[2].lower() or "_")) if number else None
    if size is None or size > most:
        spark.conf.set(key, most)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches and of broadcasts unasked, if they may be larger (it stays so: results are lazy)."""
    _at_most(spark, "spark.sql.autoBroadcastJoinThreshold", AUTO_BROADCAST_BYTES)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark.conf.get(key, None)
    if most is None or not most.rstrip("bB").isdigit() or int(most.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Give memory that is free inside this Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """``run``, a function for mapInArrow, whose worker keeps no free memory when a task ends."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return outer


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tesselon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Partitions of the input whose links or screened rows go to one file.
MERGED = 8


def merged(df: DataFrame, parts: int) -> DataFrame:
    """The few or narrow rows of ``parts`` tasks in an eighth of the partitions, whether or not adaptive execution merges any.

    Else they make a file a task.  Where Hadoop's native library is missing, a local folder costs the executor several
    processes a file, which set modes.
    """
    return df.repartition(math.ceil(parts / MERGED))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    """Partitions of at most about ``each`` bytes, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / each), 1)


def place_among(value, bounds: list, literal=F.lit):
    """How many of the sorted ``bounds`` are at most ``value``: found in two steps, so a row costs about 2 sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    upto = lambda edges: F.size(F.filter(edges, lambda b: b <= value))
    ends = F.array(*[literal(g[-1]) for g in groups[:-1]]) if len(groups) > 1 else None
    if ends is None:
        return upto(F.array(*[literal(b) for b in bounds]))
    at = upto(ends)
    return at * width + upto(F.get(F.array(*[F.array(*[literal(b) for b in g]) for g in groups]), at))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have (in any case), made from these."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key that a shuffled join leaves in one task; keys with more are dealt over several.
HOT = 512


def ways(rows):
    """Over how many tasks a key of so many rows is dealt."""
    return F.ceil(rows / HOT).cast("int")


def spread_join(big: DataFrame, small: DataFrame, key: str, rows: str, by: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, unique in the stored table ``small``, whose column ``rows`` counts the key's rows in ``big``.

    Rows of keys with more than ``HOT`` of them are dealt over several tasks by a hash of ``by``, and the
    other side's row is copied to each.
    """
    hot = small.filter(F.col(rows) > HOT).select(key, ways(F.col(rows)).alias("_ways"))
    salt = F.pmod(F.xxhash64(by), F.coalesce("_ways", F.lit(1))).cast("int")
    dealt = sized_join(big, hot, key, "left", 24).withColumn("_salt", salt).drop("_ways")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), ways(F.col(rows)) - 1)))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def sized_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str, row_bytes: int, payload: str | None = None) -> DataFrame:
    """Join with ``small`` broadcast if its measured size allows, else shuffled.

    ``small`` should be a stored table: it is read once to be measured and once to be joined.
    """
    aggregates = [F.count(F.lit(1)).alias("n"), (F.sum(F.octet_length(payload)) if payload else F.lit(0)).alias("b")]
    row = small.agg(*aggregates).first()
    size = row["n"] * row_bytes + (row["b"] or 0)
    side = F.broadcast(small) if size <= BROADCAST_BYTES else small.hint("merge")
    return big.join(side, on, how)
