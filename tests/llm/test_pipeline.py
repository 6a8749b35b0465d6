"""The pipeline against plain versions of its stages, and the queries' registration."""

import numpy as np
import public_tokenizers as pt
import pytest
from brute import components, deduplicated
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, documents, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    documents.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_classifier"](spark, docs, folder).cache()
    assert kept.columns == columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(range(0, 130)) <= set(texts)  # clean prose stays

    one = stages["jaccard_groups"](spark, kept, folder).cache()
    group = components(texts.items())
    left = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == columns and set(left) == {i for i, (_, c) in group.items() if c == i}

    clean = stages["substring_dedup"](spark, one, folder).cache()
    want = deduplicated(left.items())
    assert clean.columns == columns and clean.count() == len(left)
    for r in clean.collect():
        n, words = want[r.doc_id]
        assert r.text == (left[r.doc_id] if n == len(words) else " ".join(words))
        assert n == len(words) or r.n_chars == len(r.text)

    pieces = stages["packing"](spark, clean, folder).collect()
    tokenizer = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in clean.collect())
    assert sum(r.length for r in pieces) == total and {r.doc_id for r in pieces} == set(left)
    assert max(r.sequence_id for r in pieces) == (total - 1) // 2048


def test_run_applies_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    order = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert np.array_equal([s * 2048 + o for s, o, _ in order], np.cumsum([0, *[n for *_, n in order[:-1]]]))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
