"""Nulls, empty and long texts, repeated rows, empty tables and clashing names: each case has a defined result."""

import hashlib

import public_tokenizers as pt
import pytest
from brute import components, deduplicated

from tesselon.llm import anchor_dedup, avi, byte_bpe, concat_cut, cws, importance, jaccard_join, ngram_trie

RANKS, WORD_BPE = pt.path("byte_bpe_50k.tiktoken"), pt.path("word_bpe_49k.json")

PER_ROW = {
    "importance": lambda d, m: importance.selected(d, m),
    "trie": lambda d, m: ngram_trie.scored(d),
    "join": lambda d, m: jaccard_join.document_components(d),
    "fingerprints": lambda d, m: cws.fingerprint_pairs(d),
    "media": lambda d, m: avi.text_media(d),
    "bytes": lambda d, m: byte_bpe.round_trip(d, RANKS, pt.PATTERN),
    "dedup": lambda d, m: anchor_dedup.digests(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_a_row(odd_documents, labels, name):
    rows = PER_ROW[name](odd_documents, labels).collect()
    ids = sorted([r.doc_id for r in rows], key=lambda i: (i is None, i or 0))
    assert ids == [7, 8, 8, 8, 9, 10, None, None]
    assert len({tuple(r) for r in rows if r.doc_id == 8}) == (2 if name == "fingerprints" else 1)  # the last copy is followed by 7


@pytest.mark.parametrize("name", [*PER_ROW, "pack"])
def test_empty_tables(documents, labels, name):
    empty = documents.limit(0)
    assert (concat_cut.pack(empty, WORD_BPE) if name == "pack" else PER_ROW[name](empty, labels.limit(0))).count() == 0


def test_packing_odd_rows(odd_documents):
    rows = concat_cut.pack(odd_documents, WORD_BPE).collect()
    assert sum(r.length for r in rows) == rows[0].sequence_id * 2048 + max(r.offset + r.length for r in rows)
    assert sum(1 for r in rows if r.doc_id == 8) == 3 and [r.length for r in rows if r.doc_id == 7] == [1]


def test_missing_labels_keep_everything(documents, labels):
    assert importance.selected(documents, labels.filter("quality = 5")).count() == documents.count()
    assert importance.selected(documents, None).count() == documents.count()


def test_stages_keep_columns_and_other_rows(odd_documents, labels):
    for stage in (lambda d: importance.select_documents(d, labels), jaccard_join.one_of_each, anchor_dedup.cleaned):
        assert stage(odd_documents).columns == odd_documents.columns
    one = jaccard_join.one_of_each(odd_documents).collect()
    assert sorted((r.doc_id or -1) for r in one) == [-1, -1, 7, 8, 10]  # 9 is near 8; of the copies of 8 one stays
    cleaned = {r.doc_id: r for r in anchor_dedup.cleaned(odd_documents).collect() if r.doc_id is not None}
    assert cleaned[9].text == "more" and cleaned[9].n_chars == 4 and cleaned[9].key == 0.0 and cleaned[7].text is None


def test_very_long_texts(spark):
    long = " ".join(f"z{i % 4001}" for i in range(120_000)) + " " + "y" * 300_000
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text of few words here")], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.document_components(docs).collect()} == components(rows)
    want = deduplicated(rows)
    for r in anchor_dedup.digests(docs).collect():
        n, kept = want[r.doc_id]
        assert (r.n_words, r.kept_sha256) == (n, hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert ngram_trie.scored(docs).count() == cws.fingerprint_pairs(docs).count() == avi.text_media(docs).count() == 3
    assert sum(r.length for r in concat_cut.pack(docs, WORD_BPE).collect() if r.doc_id == 3) > 0


def test_documents_without_or_with_the_same_id_stay_apart(spark):
    prose = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, prose("a")), (None, prose("b")), (None, prose("c")), (None, prose("c") + " more"), (5, prose("b") + " more"), (6, prose("d")), (6, prose("e")), (6, prose("e")), (7, prose("d") + " more"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in jaccard_join.one_of_each(docs).collect()]
    texts = sorted((t or "").removesuffix(" more") for _, t in left)
    assert texts == sorted(["", *(prose(name) for name in "abcde")])  # one of each group, and every group
    assert {(6, prose("d")), (6, prose("e")), (None, prose("b")), (None, None)} <= set(left)
    found = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.document_components(docs.filter("doc_id is not null")).collect()}
    assert found == {(5, 37): 5, (6, 36): 6, (7, 37): 6}


def test_very_long_texts_through_every_encoder(spark):
    """A text of a million characters beside a short one, checked in full."""
    import numpy as np
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    from tesselon.llm import wordbytes

    long = " ".join(f"z{i % 977} Walk, é{i % 13}" for i in range(70_000)) + "y" * 30_000
    docs = spark.createDataFrame([(1, long), (2, "short text")], "doc_id long, text string")
    plain = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    found = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, pt.PATTERN).collect()}
    ids = plain.encode_ordinary(long)
    assert found[1].n_tokens == len(ids) and found[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    pieces = sorted(((r.start, np.frombuffer(r.ids, f"<u{r.ids_width}")) for r in concat_cut.pack(docs, WORD_BPE).collect() if r.doc_id == 1), key=lambda p: p[0])
    assert np.concatenate([p for _, p in pieces]).tolist() == [*Tokenizer.from_file(WORD_BPE).encode(long, add_special_tokens=False).ids, 1]
    media = {r.doc_id: r for r in avi.text_media(docs).collect()}
    assert media[1].payload_sha256 == hashlib.sha256(avi.payload_of(long.encode())).hexdigest()
    assert importance.weighed(docs, None).filter("k1 = 1").first().n_grams > 400_000
    names = wordbytes.split_words(pa.array([long, "short text"])).hashes(lower=True)
    assert names[-1] == wordbytes.split_words(pa.array(["text"])).hashes(lower=True)[0]


def test_general_and_table_decoders_agree(monkeypatch):
    texts = [b"", b"one two", bytes(range(256)) * 9]
    monkeypatch.setattr(avi, "GENERAL", 1)
    general = [avi.media_row(t) for t in texts]
    monkeypatch.setattr(avi, "GENERAL", 1 << 40)
    table = [avi.media_row(t) for t in texts]
    for g, t in zip(general, table, strict=True):
        assert "decoder=general" in g[6] and (*g[:6], g[6].replace("general", "table"), g[7]) == t
        assert t[7].startswith("0-") and t[7].count(";") + 1 == int(t[6].rsplit("=", 1)[1])


def test_tokenizers_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="case"):
        concat_cut.token_ids(__import__("pyarrow").array(["a"]), pt.path("byte_bpe_50k.json"))


def test_repeated_and_tied_urls(spark):
    from tesselon.llm import url_rules

    pages = spark.createDataFrame([(1, "http://a.b.c/x1")] * 3 + [(2, "http://" + "d." * 3000 + "b.c/x1"), (None, None)], "page_id long, url string")
    rules = url_rules.rule_frame(spark, [("allow", "a.b.c", "/"), ("block", "b.c", "/x1"), ("allow", "b.c", "/x1"), ("block", "c", "/x1zz")])
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect())
    # 'a.b.c/' and 'b.c/x1' have six characters each: the longer host wins; of one host's equal rules, block.
    assert got == [(0, None, "allow"), *[(1, "a.b.c/", "allow")] * 3, (2, "b.c/x1", "block")]


def test_pipeline_on_odd_tables(spark, odd_documents, labels, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd_documents), ("none", odd_documents.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(rows) == 0 if name == "none" else {r.doc_id for r in rows} <= {7, 8, 9, 10, None} and sum(r.length for r in rows) > 0
