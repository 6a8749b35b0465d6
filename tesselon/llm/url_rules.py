"""URL filter: a sort-merge range join of page URLs with nested host rules.

A host ``www.example.com`` becomes the canonical key ``com.example.www.``; every host under
a rule's host has a key in the interval ``[key(rule), key(rule) with the last '.' replaced by
'/')``, because '/' follows '.' in byte order.  Such intervals nest by label count, so a sweep in
key order needs one stack slot for each label count that rules have: the last rule host begun at
that depth, still active while its end lies ahead.  The sweep is one window over each key range.

Only DataFrame functions are used.  Key ranges, twice the session's shuffle partitions, come from a
sample of about ``SAMPLE_PER_RANGE`` keys a range (it sets the division of work only, never results);
a key that many pages share is divided further by a hash of the URL.

Cases: a null URL or one without ``://`` has empty host and path, no rule and the default
verdict; repeated rows stay repeated; of rules of equal length the longer host wins, then ``block``;
a very long URL or host is a key like others; no pages or no rules give an empty or rule-less result;
further columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselon.llm.cluster import place_among

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE_PER_RANGE = 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _fitting(slot: Column) -> Column:
    """The rules of an active slot's host whose path starts the page's path."""
    paths = F.filter(slot["paths"], lambda p: F.startswith(F.col("_path"), p["path"]))
    entries = F.transform(
        paths,
        lambda p: F.struct(
            (F.length(slot["host"]) + F.length(p["path"])).alias("size"),
            F.length(slot["host"]).alias("labels"),
            p["action"].alias("action"),
            F.concat(slot["host"], p["path"]).alias("rule"),
        ),
    )
    empty = F.expr("cast(array() as array<struct<size:int,labels:int,action:string,rule:string>>)")
    return F.when(slot.isNotNull() & (F.col("_key") < slot["stop"]), entries).otherwise(empty)


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """Return ``keep`` columns, host, path, rule (host and path, or null) and verdict of each page.

    ``rules`` has action, host and path.  A rule fits its host and all subdomains if the path starts
    with the rule's path; the rule with most characters wins, then the longer host, then ``block``.
    The path rules of one host travel in one row; their number must fit a task's memory.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    points = pages.select(*[F.col(c).alias(f"_k_{c}") for c in keep], host.alias("_host"), path.alias("_path"))
    points = points.withColumn("_key", host_key(F.col("_host"))).withColumn("_salt", F.xxhash64("_path", *[f"_k_{c}" for c in keep]))

    by_host = (
        rules.filter("host is not null and host <> '' and action is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("host")
        .agg(F.array_sort(F.collect_set(F.struct("path", "action"))).alias("paths"))
        .withColumn("start", host_key(F.col("host")))
        .withColumn("stop", F.concat(F.expr("substring(start, 1, length(start) - 1)"), F.lit("/")))
        .withColumn("depth", F.size(F.split("host", r"\.", -1)))
    )
    depths = [r[0] for r in by_host.select("depth").distinct().orderBy("depth").collect()]  # label counts: 127 at most by the DNS

    ranges = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = points.count()
    want = ranges * SAMPLE_PER_RANGE
    sample = points.select("_key", "_salt").sample(min(1.0, 2.0 * want / max(total, 1)), 7).limit(2 * want).collect()
    sample = sorted((r[0].encode(), r[0], r[1]) for r in sample)
    bounds = [sample[i * len(sample) // ranges][1:] for i in range(1, ranges)] if len(sample) >= ranges else []

    def range_of(key: Column, salt: Column) -> Column:
        return place_among(F.struct(key.alias("k"), salt.alias("s")), bounds, lambda b: F.struct(F.lit(b[0]).alias("k"), F.lit(b[1]).alias("s")))

    low, high = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    points = points.withColumn("_range", range_of(F.col("_key"), F.col("_salt"))).withColumn("_kind", F.lit(1))
    starts = (
        by_host.withColumn("_from", range_of(F.col("start"), low))
        .withColumn("_to", range_of(F.col("stop"), high))
        .select(
            F.explode(F.sequence("_from", "_to")).alias("_range"),
            F.col("start").alias("_key"),
            F.lit(0).alias("_kind"),
            F.lit(0).cast("long").alias("_salt"),
            F.struct("host", "stop", "paths", "depth").alias("_rule"),
        )
    )
    swept = points.unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy("_range").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    for d in depths:
        swept = swept.withColumn(f"_slot{d}", F.last(F.when(F.col("_rule.depth") == d, F.col("_rule")), ignorenulls=True).over(order))
    active = [_fitting(F.col(f"_slot{d}")) for d in depths]
    best = F.array_max(F.concat(*active)) if active else F.expr("cast(null as struct<size:int,labels:int,action:string,rule:string>)")
    return (
        swept.filter("_kind = 1")
        .withColumn("_best", best)
        .select(
            *[F.col(f"_k_{c}").alias(c) for c in keep],
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.col("_best.rule").alias("rule"),
            F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"),
        )
    )
