"""A corpus pipeline: quality selection, one document of each near-duplicate group, no repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns rows
with the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import anchor_dedup, cluster, concat_cut, importance, jaccard_join


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance resample; the labels are those of the input."""
    return importance.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id has too."""
    return anchor_dedup.cleaned(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences."""
    return concat_cut.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_groups", jaccard_groups),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can't express the first stage's model nor the last one's tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cluster.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
