"""Incremental scoring and deduplication.  Progress is the stream's checkpoint, so a restarted run goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, name: str, files_a_batch: int = 8) -> DataFrame:
    """The files of one table in ``folder`` as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if not _is_folder(spark, f"{folder}/{name}.parquet") else source.parquet(f"{folder}/{name}.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def run_available(stream: DataFrame, out: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Process what is there and stop.  A batch that is repeated after a failure replaces its own part of ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        rows = step(batch, number) if step else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_of_key(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The first event of each key; state older than ``lateness`` is dropped with the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
