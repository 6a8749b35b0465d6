"""Substring dedup with difference-cover anchors.

{0, 1, 3} is a difference cover modulo 7: whatever two positions are, some shift of 0 to 6 puts
both at cover positions.  So of two equal runs of ``WINDOW`` = 13 words, wherever they lie, some
7-word window lies at a cover position in both.  Only those anchors (3 of 7 positions) are hashed and
compared at first.  Windows that contain a shared anchor are then extended to all 13 words and
compared by 128 bits, two chains over both halves of the words' BLAKE2b digests, so no text can be
made that loses words which no other has.  A word is removed if a window that covers it also starts
in a document of smaller id.

Cases: a null, empty or short text (under 13 words) loses nothing; rows of one doc_id don't remove
from each other; equal rows fare alike; a null doc_id counts as smaller than all others; extra
columns are not read; a very long text is a chunk by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import cluster, exchange
from tesselon.llm.wordbytes import Words, gram_hashes, gram_positions, slices, split_words

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_NULL_ID = -(1 << 63)


def _spans(doc: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> list[bytes]:
    """Of each document: its intervals [low, high), sorted and merged where they touch, as pairs of 32-bit integers."""
    if not len(doc):
        return [b""] * n
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    far = np.maximum.accumulate(high + doc * (1 << 40)) - doc * (1 << 40)  # within a document, as documents ascend
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > far[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(doc)) - 1
    pairs = np.stack([low[at], far[ends]], 1).astype("<i4")
    cuts = np.searchsorted(doc[at], np.arange(n + 1)).tolist()
    return [pairs[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _home_header(piece: pa.RecordBatch, words: Words) -> list[np.ndarray]:
    return [piece.column("k1").to_numpy(zero_copy_only=False), piece.column("k2").to_numpy(zero_copy_only=False), words.first.astype(np.int64)]


def _anchors(piece: pa.RecordBatch, chunk: int, buckets: int) -> Iterator[tuple]:
    words = split_words(piece.column("text"))
    doc, at = gram_positions(words.first, ANCHOR)
    where = at - words.first[doc]
    chosen = np.isin(where % PERIOD, COVER) & (np.diff(words.first)[doc] >= WINDOW)
    doc, at = doc[chosen], at[chosen]
    hashes = gram_hashes(words.hashes(lower=False), ANCHOR, at)
    asked = exchange.Chunk(((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), hashes.astype(np.uint32), at, buckets)
    ids = piece.column("k1").to_numpy(zero_copy_only=False)
    owner = ids[np.searchsorted(words.first, asked.refs, "right") - 1]
    several = _spread(owner, asked.starts)
    yield from asked.rows(chunk, several.astype(np.uint8), _home_header(piece, words))


def _spread(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each run's values differ."""
    if not len(starts):
        return np.zeros(0, bool)
    return np.minimum.reduceat(values, starts) != np.maximum.reduceat(values, starts)


def _header(home: exchange.Home) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(h, np.int64) for h in home.header)


def _rows(k1: np.ndarray, k2: np.ndarray, spans: list[bytes]) -> pa.RecordBatch:
    some = [i for i, s in enumerate(spans) if s]
    return pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), pa.array([spans[i] for i in some], pa.binary())], names=["k1", "k2", "spans"])


def _candidates(home: exchange.Home, shared: np.ndarray, _keys: list) -> pa.RecordBatch:
    """Intervals of window starts near shared anchors."""
    k1, k2, first = _header(home)
    at = home.refs[shared[home.run] > 0] if len(home.refs) else home.refs
    doc = np.searchsorted(first, at, "right") - 1
    where = at - first[doc]
    last = np.diff(first)[doc] - WINDOW
    return _rows(k1, k2, _spans(doc, np.maximum(where - PERIOD + 1, 0), np.minimum(where, last) + 1, len(k1)))


def _windows(piece: pa.RecordBatch, chunk: int, buckets: int) -> Iterator[tuple]:
    words = split_words(piece.column("text"))
    spans = [np.frombuffer(s, "<i4").reshape(-1, 2).astype(np.int64) + words.first[i] for i, s in enumerate(piece.column("spans").to_pylist())]
    spans = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
    size = spans[:, 1] - spans[:, 0]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - spans[:, 0], size)
    key = gram_hashes(words.hashes(lower=False), WINDOW, at, 11)
    check = gram_hashes(words.hashes(lower=False, half=1), WINDOW, at, 13)
    asked = exchange.Chunk((check % np.uint64(buckets)).astype(np.int64), key, at, buckets, check)
    ids = piece.column("k1").to_numpy(zero_copy_only=False)
    owner = ids[np.searchsorted(words.first, asked.refs, "right") - 1]
    least = np.minimum.reduceat(owner, asked.starts) if len(asked.starts) else owner
    yield from asked.rows(chunk, least, _home_header(piece, words))


def _covered(home: exchange.Home, earlier: np.ndarray, _keys: list) -> pa.RecordBatch:
    """Intervals of words that windows of smaller documents cover."""
    k1, k2, first = _header(home)
    doc = np.searchsorted(first, home.refs, "right") - 1
    own = k1[doc] if len(doc) else np.zeros(0, np.int64)
    starts = np.flatnonzero(home.new)
    least = np.minimum.reduceat(own, starts)[home.run] if len(starts) else own
    gone = (earlier[home.run] > 0) | (own > least) if len(own) else np.zeros(0, bool)
    where = (home.refs - first[doc])[gone]
    return _rows(k1, k2, _spans(doc[gone], where, where + WINDOW, len(k1)))


def removed_spans(docs: DataFrame) -> DataFrame:
    """Of each document that loses words: k1, k2 and its spans of word numbers, as a stored table."""
    spark = docs.sparkSession
    keyed = exchange.with_keys(docs)
    parts = exchange.partitions(spark, cluster.text_bytes(docs))
    schema = "k1 long, k2 long, spans binary"
    asked = exchange.ask(keyed, _anchors, parts)
    near = exchange.collect_home(exchange.answer(asked, parts, exchange.reply_shared), parts, _candidates, "u1", schema)
    near = cluster.stored(near.dropDuplicates(["k1", "k2"]), "candidates")
    met = cluster.sized_join(keyed, near, ["k1", "k2"], "inner", 40, "spans")
    asked = exchange.ask(met, _windows, parts)
    found = exchange.collect_home(exchange.answer(asked, parts, exchange.reply_earlier), parts, _covered, "u1", schema)
    return cluster.stored(found.dropDuplicates(["k1", "k2"]), "removed")


def _kept(text: str, spans: bytes | None) -> tuple[list[bytes], int]:
    """Kept words and the number of removed ones."""
    words = (text or "").encode().split()  # of bytes: at the six ASCII white-space characters
    if not spans:
        return words, 0
    kept, at = [], 0
    for low, high in np.frombuffer(spans, "<i4").reshape(-1, 2).tolist():
        kept += words[at:low]
        at = high
    kept += words[at:]
    return kept, len(words) - len(kept)


def deduplicated(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, n_words, n_removed, kept (the kept words joined by spaces) of every row; the other columns are dropped."""
    return _finish(docs, removed_spans(docs), keep_text=True)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return _finish(docs, removed_spans(docs), keep_text=False)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns; texts that lose words become their kept words joined by spaces, and n_chars follows."""
    a, b, held, new = cluster.fresh(docs, "_k1", "_k2", "_spans", "_new")
    spans = removed_spans(docs).select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("spans").alias(held))
    met = cluster.sized_join(exchange.named(docs, a, b), spans, [a, b], "left", 40, held)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if s is None else b" ".join(_kept(t, s)[0]).decode() for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    hit = F.col(held).isNotNull()
    met = met.withColumn(new, cut(F.when(hit, F.col("text")), held))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.when(hit, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(hit, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return met.select(*[v.alias(c) for c, v in out.items()])


def _finish(docs: DataFrame, removed: DataFrame, keep_text: bool) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(), F.col("text"))
    met = cluster.sized_join(keyed, removed, ["k1", "k2"], "left", 40, "spans").select("doc_id", "k1", "k2", "text", "spans")
    last = pa.field("kept", pa.string()) if keep_text else pa.field("kept_sha256", pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                n, gone, out = [], [], []
                for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                    kept, lost = _kept(text, spans)
                    n.append(len(kept) + lost)
                    gone.append(lost)
                    joined = b" ".join(kept)
                    out.append(joined.decode() if keep_text else hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "k1", "k2", "n_words", "n_removed", last.name])

    out = met.mapInArrow(cluster.tidy(run), f"doc_id long, k1 long, k2 long, n_words long, n_removed long, {last.name} string")
    return out if keep_text else out.drop("k1", "k2")


def _keys():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")
