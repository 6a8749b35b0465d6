"""The resumable flows, run over what the events table holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tesselon.plans import roles
from tesselon.plans.roles import rounded
from tesselon.streaming import flows

query = roles.Registry()
QUERIES, SQL = query.queries, query.sql


def _place(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="tesselon-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT event_id, round(1 / (1 + exp(-(value / 500 - 0.5))), 6) AS prob FROM events WHERE event_type <> 'error'")
def stream_resume_scoring(spark, sf_dir):
    place = _place(spark)
    stream = flows.file_stream(spark, sf_dir, "events")
    score = lambda batch, _: batch.filter("event_type <> 'error'").select("event_id", (1 / (1 + F.exp(-(F.col("value") / 500 - 0.5)))).alias("prob"))
    flows.run_available(stream, f"{place}/out", f"{place}/log", score)
    return rounded(spark.read.parquet(f"{place}/out").select("event_id", "prob"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    place = _place(spark)
    events = flows.file_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = flows.first_of_key(events, ["user_id", "event_type"], "ts", "365 days")
    flows.run_available(stream.select("user_id", "event_type"), f"{place}/out", f"{place}/log")
    return spark.read.parquet(f"{place}/out").select("user_id", "event_type")
