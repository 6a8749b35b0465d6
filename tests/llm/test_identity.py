"""Words are told apart by their bytes: texts made so that a polynomial hash modulo 2**64 takes them for one another."""

import hashlib

import numpy as np
import public_tokenizers as pt
import pyarrow as pa
import pytest
import tiktoken
from brute import components, deduplicated
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesselon.llm import anchor_dedup, byte_bpe, cluster, concat_cut, exchange, jaccard_join, wordbytes

RANKS, WORD_BPE = pt.path("byte_bpe_50k.tiktoken"), pt.path("word_bpe_49k.json")


def twins(n):
    """The Thue-Morse word of n letters and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n", [1024, 2048])
def test_components_keep_twins_apart(spark, n):
    texts = [f"the same four words {t}" for t in twins(n)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.document_components(frame(spark, texts)).collect()}
    assert found == {0: (1, 0), 1: (1, 1)} == components(enumerate(texts))


@pytest.mark.parametrize("n", [1024, 2048])
def test_encodings_keep_twins_apart(spark, n):
    texts = list(twins(n))
    plain = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for r in byte_bpe.round_trip(frame(spark, texts).coalesce(1), RANKS, pt.PATTERN).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, plain.encode_ordinary(texts[r.doc_id]))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids, counts = concat_cut.token_ids(pa.array(texts), WORD_BPE)
    assert np.split(ids, np.cumsum(counts)[:-1])[1].tolist() == [*tokenizer.encode(texts[1], add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [1024, 2048])
def test_dedup_keeps_twins_apart(spark, n):
    texts = [" ".join([*(f"common{i}" for i in range(12)), t]) for t in twins(n)]
    assert {r.doc_id: r.n_removed for r in anchor_dedup.digests(frame(spark, texts)).collect()} == {0: 0, 1: 0}
    assert [len(k) for _, k in deduplicated(enumerate(texts)).values()] == [13, 13]


def test_names_differ_and_grams_are_not_linear():
    a, b = twins(2048)
    words = wordbytes.split_words(pa.array([f"{a} {b} {a}"]))
    names = words.hashes(lower=True)
    assert names[0] == names[2] != names[1]
    swapped = wordbytes.gram_hashes(np.array([5, 9, 9, 5], np.uint64), 2, np.array([0, 2]))
    assert swapped[0] != swapped[1]


def test_names_follow_the_bytes_alone():
    words = ["", "a", "a\0", "\0", "\0\0", "abcdefgh", "abcdefg", "abcdefghi", "é", "x" * 100, "abcdefgh" * 2]
    names = wordbytes.digests(pa.array([w.encode() for w in words], pa.large_binary()))
    assert len({tuple(n) for n in names.tolist()}) == len(set(names[:, 0].tolist())) == len(set(names[:, 1].tolist())) == len(words)
    again = wordbytes.digests(pa.array([b"zz", *(w.encode() for w in words[::-1])], pa.binary())[1:])
    assert (again == names[::-1]).all()
    rng = np.random.default_rng(0)
    many = wordbytes.digests(pa.array([rng.bytes(int(n)) for n in rng.integers(5, 9, 200_000)], pa.large_binary()))
    bits = np.unpackbits(many.view(np.uint8), axis=1).mean(0)
    assert np.abs(bits - 0.5).max() < 0.01


def test_equal_keys_are_parted_by_their_checks():
    key, check = np.array([7, 7, 7, 3], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    chunk = exchange.Chunk(np.zeros(4, np.int64), key, np.arange(4), 1, check)
    assert chunk.key.tolist() == [[3, 1], [7, 1], [7, 2]] and chunk.refs.tolist() == [3, 0, 2, 1]
    packed = [np.stack([k, c], 1).astype("<u8").tobytes() for k, c in (([7, 7], [1, 2]), ([7], [2]))]
    found = exchange.reply_earlier(packed, [np.array([5, 5], "<i8").tobytes(), np.array([4], "<i8").tobytes()])
    assert [f.tolist() for f in found] == [[0, 1], [0]]


@pytest.mark.parametrize("parts", [1, 7, 51, 211])
def test_places_reach_every_partition_once(spark, parts):
    at = exchange.places(parts)
    rows = spark.createDataFrame([(int(x),) for x in at], "place int")
    dealt = rows.select(F.pmod(F.hash("place"), F.lit(parts)).alias("p"), "place").collect()
    assert sorted((r.p, r.place) for r in dealt) == list(enumerate(at.tolist()))


def test_hot_signatures_are_dealt_over_tasks(spark, monkeypatch):
    """Groups larger than a task's share and than a block, of near copies and of texts that only share a passage."""
    monkeypatch.setattr(cluster, "HOT", 4)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
    rng = np.random.default_rng(8)
    word = lambda: f"v{rng.integers(0, 5000)}"
    passage, base = [word() for _ in range(30)], [word() for _ in range(60)]
    texts = []
    for i in range(120):
        if i % 2:
            texts.append(" ".join([*passage, *(word() for _ in range(14))]))
        else:
            near = list(base)
            for p in rng.integers(0, 60, int(rng.integers(0, 4))):
                near[p] = word()
            texts.append(" ".join(near))
    for i in range(1, 60, 6):
        texts.append(texts[i] + " more")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.document_components(frame(spark, texts)).collect()}
    assert got == components(enumerate(texts))
