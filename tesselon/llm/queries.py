"""The thin queries of the operators: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import anchor_dedup, avi, byte_bpe, chat_events, cluster, concat_cut, cws, importance, jaccard_join, ngram_trie, url_rules

#: action, host, path
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.selected(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.scored(_read(spark, sf_dir, "documents"))


def op3_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.document_components(_read(spark, sf_dir, "documents")).drop("k1", "k2")


def op4_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_pairs(_read(spark, sf_dir, "documents"))


def op5_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.text_media(_read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, told as a log of streamed, edited, regenerated and retracted messages and folded back."""
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    events = cluster.stored(chat_events.event_log(rows.unionByName(control)), "events")
    return chat_events.turn_digests(chat_events.parse(chat_events.render(chat_events.fold_events(events))))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_read(spark, sf_dir, "pages"), url_rules.rule_frame(spark, URL_RULES))


def op9_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces; the ids themselves are the operator's output."""
    return concat_cut.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids_width", "ids")


def op10_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_dedup.digests(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_importance_resampling, op2_ngram_trie, op3_jaccard_components, op4_cws_fingerprints, op5_avi_mjpeg, op6_byte_bpe, op7_chat_events, op8_url_rules, op9_concat_cut, op10_anchor_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from tesselon.llm.sql import ORACLES

    return dict(ORACLES)
