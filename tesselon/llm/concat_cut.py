"""Packing by concatenate and cut.

Pass one tokenises every document once and stores, for each task's partition, the ids with the
tokens that precede them in it.  The partitions' totals (one number a task) give, by a prefix sum,
the global offset of each partition.  Pass two cuts each document where multiples of the sequence
length fall and emits one record a piece, its boundaries and ids.  Nothing is shuffled and no task holds more
than a batch of documents; only the last sequence is padded.

Cases: a null or empty text is its end token alone; equal rows are packed as often as they occur;
a long document spans as many sequences as it needs; no documents give no pieces; a null doc_id
stays null; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import cluster
from tesselon.llm.token_cache import SegmentCache, WordCache
from tesselon.llm.wordbytes import Words, coded, lowered, slices, split_words

SEQUENCE_LENGTH = 2048
END_ID = 1
#: Stands between words that are encoded together; it holds white space, so it occurs in none.
MARK = "\n<mark> \n"
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_caches: dict[str, SegmentCache] = {}


def _check(tokenizer, path: str) -> None:
    """Raise unless words, with a closing mark split off and in either case, are encoded independently."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    word, mark, other = ids("walk"), ids(","), ids("b2b")
    for text, want in (("WaLK", word), ("  walk\n\t walk ", word + word), ("walk,", word + mark), ("walk, B2B walk", word + mark + other + word), ("b2b,", other + mark)):
        if ids(text) != want:
            raise ValueError(f"the tokenizer of {path} doesn't ignore case and white space or doesn't part words from marks")


def _cache(path: str) -> SegmentCache:
    if path not in _caches:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _check(tokenizer, path)
        word_end = getattr(tokenizer.model, "end_of_word_suffix", None)
        _caches[path] = WordCache(tokenizer, MARK, word_end) if word_end else SegmentCache(tokenizer, MARK)
    return _caches[path]


def _segments(texts: pa.Array) -> tuple[Words, np.ndarray, pa.Array, np.ndarray]:
    """Words, with a closing mark after an ASCII letter or digit split off: their numbers and distinct contents, and segments before each word."""
    words = split_words(texts)
    buf, start, end = words.buf, words.start, words.end
    split = (end - start > 1) & _CLOSING[buf[end - 1]]
    split &= _PLAIN[buf[np.maximum(end - 2, 0)]]
    before = np.concatenate([[0], np.cumsum(1 + split)])
    at = before[:-1][split] + 1
    starts, ends = np.empty(before[-1], np.int64), np.empty(before[-1], np.int64)
    starts[before[:-1]], ends[before[:-1]] = start, end - split
    starts[at], ends[at] = end[split] - 1, end[split]
    # Case in A-Z doesn't matter to ids, but it does to special tokens, which hold a '<'.
    plain = lowered(buf)
    angled = np.concatenate([[0], np.cumsum(buf == 60)])
    for i in np.flatnonzero(angled[ends] > angled[starts]).tolist():
        plain[starts[i] : ends[i]] = buf[starts[i] : ends[i]]
    return words, *coded(plain, starts, ends), before


def token_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, each closed by ``end_id``, and the count of each.

    The tokenizer must drop white space, ignore case and part words from closing marks, as the
    default one does (it is tried when it is loaded): segments are then encoded independently.
    """
    words, codes, contents, before = _segments(texts)
    ids, counts, _ = _cache(path).ids(codes, contents)
    upto = np.concatenate([[0], np.cumsum(counts)])[before[words.first]]
    out = np.insert(ids, upto[1:], end_id)
    return out, np.diff(upto) + 1


def tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """part, local_start, doc_id, doc_tokens and ids (little-endian unsigned 16- or 32-bit, by ``width``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, counts = token_ids(piece.column("text"), tokenizer_path)
                width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
                raw = ids.astype(f"<u{width}").tobytes()
                ends = np.cumsum(counts)
                cuts = [0, *(ends * width).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(seen + ends - counts),
                        piece.column("doc_id"),
                        pa.array(counts),
                        pa.array(np.full(len(counts), width, np.int32)),
                        pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    ],
                    names=["part", "local_start", "doc_id", "doc_tokens", "width", "ids"],
                )
                seen += int(ends[-1])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cluster.tidy(run), "part int, local_start long, doc_id long, doc_tokens long, width int, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids_width, ids.

    ``ids`` are the piece's token ids, little-endian and unsigned, of ``ids_width`` bytes each; ids_crc32 is
    of the same ids in 32 bits.
    """
    cluster.small_batches(docs.sparkSession)
    table = cluster.stored(tokenised(docs, tokenizer_path), "tokens")
    totals = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}  # one number a task
    base, upto = {}, 0
    for part in sorted(totals):
        base[part] = upto
        upto += totals[part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            columns = [batch.column(i).to_pylist() for i in range(5)]
            raws = batch.column(5)
            for i, (part, local, doc_id, tokens, width) in enumerate(zip(*columns, strict=True)):
                raw = raws[i].as_py()
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                begin, done = base[part] + local, 0
                while done < tokens:
                    sequence, offset = divmod(begin + done, length)
                    size = min(length - offset, tokens - done)
                    crc = zlib.crc32(ids[done : done + size].tobytes())
                    for out, value in zip(rows, (doc_id, done, size, crc, tokens, sequence, offset, width, raw[done * width : (done + size) * width]), strict=True):
                        out.append(value)
                    done += size
            types = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids_width", "ids"])

    return table.select("part", "local_start", "doc_id", "doc_tokens", "width", "ids").mapInArrow(cluster.tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids_width int, ids binary")
