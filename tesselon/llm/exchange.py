"""A packed question-and-answer exchange over hashed features of documents.

A slice of documents (a *chunk*) has entries: a 64-bit feature hash and a reference (document or
word).  The chunk asks about each distinct hash once: questions go, packed by bucket of the hash,
to the task that owns the bucket, which answers with one byte or bit each.  The references stay in
a *home* row of the chunk and meet the answers again by chunk.  So a feature that a third of all
documents hold reaches its bucket at most once a chunk, however many documents hold it, and no
row is made per feature.  Both shuffles carry binary columns of a few kilobytes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import cluster
from tesselon.llm.wordbytes import gathered, slices

#: Text a partition of the exchange stands for, buckets a partition, and text a chunk.
PARTITION_BYTES = 32 << 20
BUCKETS_EACH = 4
CHUNK_BYTES = 3 << 20
ROWS = "place int, chunk long, bucket int, keys binary, more binary, home binary"
_SCHEMA = pa.schema([("place", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("home", pa.binary())])


def partitions(spark: SparkSession, total_bytes: int) -> int:
    return cluster.parts_for(spark, total_bytes, PARTITION_BYTES)


def with_keys(docs: DataFrame) -> DataFrame:
    """k1 and k2 name a document: doc_id (null: least) and a hash of its text; equal rows have equal keys."""
    cluster.small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def named(docs: DataFrame, k1: str, k2: str) -> DataFrame:
    """``docs`` with the two key columns added."""
    return docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), k2: F.xxhash64(F.coalesce("text", F.lit("")))})


def _murmur3(values: np.ndarray) -> np.ndarray:
    """Spark's hash of 32-bit integers (MurmurHash3, seed 42), as unsigned."""
    # Fixed values of MurmurHash3.
    first, second, add, last = np.uint32(0xCC9E2D51), np.uint32(0x1B873593), np.uint32(0xE6546B64), (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
    turned = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    h = np.uint32(42) ^ turned(values.astype(np.uint32) * first, 15) * second
    h = turned(h, 13) * np.uint32(5) + add
    h ^= np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * last[0]
    h = (h ^ h >> np.uint32(13)) * last[1]
    return h ^ h >> np.uint32(16)


def places(parts: int) -> np.ndarray:
    """For each partition an integer that ``repartition(parts, ...)`` deals to it, so that no two buckets meet by chance."""
    out, found, at = np.full(parts, -1, np.int64), 0, 0
    while found < parts:
        values = np.arange(at, at + 8 * parts)
        slot = _murmur3(values).astype(np.int32).astype(np.int64) % parts
        ids, first = np.unique(slot, return_index=True)
        fresh = out[ids] < 0
        out[ids[fresh]] = values[first[fresh]]
        found, at = int((out >= 0).sum()), at + 8 * parts
    return out


def _runs(bucket: np.ndarray | None, key: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal entries are together, and where each run of them begins."""

    def begins(order: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            own = c[order]
            new[1:] |= own[1:] != own[:-1]
        return new

    if key.dtype.itemsize <= 4:
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | key.astype(np.uint64), kind="stable")
    else:
        order = np.lexsort((key, bucket)) if bucket is not None else np.argsort(key, kind="stable")
    columns = [c for c in (bucket, key) if c is not None]
    new = begins(order, columns)
    if check is not None:
        whole = begins(order, [*columns, check])
        if (whole != new).any():  # two features share the key: the check parts them
            order = np.lexsort((check, *columns[::-1]))
            whole = begins(order, [*columns, check])
        new = whole
    return order, new


class Chunk:
    """Entries of one chunk in the order of (bucket, key); a ``check`` of 64 bits more tells equal keys apart."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray, refs: np.ndarray, buckets: int, check: np.ndarray | None = None):
        order, self.new = _runs(bucket, key, check)
        self.refs, self.buckets = refs[order], buckets
        self.starts = np.flatnonzero(self.new)
        one = order[self.starts]
        self.bucket, self.key = bucket[one], key[one] if check is None else np.stack([key[one], check[one]], 1)

    def rows(self, chunk: int, more: np.ndarray, header: list[np.ndarray]) -> Iterator[tuple]:
        """``more``: one value a distinct hash, sent along; ``header``: arrays that the home row keeps."""
        cuts = np.searchsorted(self.bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            yield b, chunk, b, self.key[cuts[b] : cuts[b + 1]].tobytes(), more[cuts[b] : cuts[b + 1]].tobytes(), None
        wide = "<u2" if not len(self.refs) or self.refs.max() < 1 << 16 else "<u4"
        blobs = [np.frombuffer(wide.encode(), np.uint8), self.refs.astype(wide), np.packbits(self.new), *header]
        sizes = np.array([len(blobs), *[b.nbytes for b in blobs]], np.int64)
        yield home(chunk), chunk, -1, None, None, sizes.tobytes() + b"".join(b.tobytes() for b in blobs)


def home(chunk: int) -> int:
    """The number that deals a chunk's home row: tasks and the chunks of a task follow each other."""
    return 31 * (chunk >> 32) + (chunk & 0xFFFFFFFF)


class Home:
    """A chunk's references, read back from its home row."""

    def __init__(self, blob: bytes):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        sizes = np.frombuffer(blob, np.int64, n, 8).tolist()
        at, parts = 8 * (n + 1), []
        for s in sizes:
            parts.append(blob[at : at + s])
            at += s
        self.refs = np.frombuffer(parts[1], parts[0].decode()).astype(np.int64)
        self.new = np.unpackbits(np.frombuffer(parts[2], np.uint8), count=len(self.refs)).astype(bool)
        self.header = parts[3:]

    @property
    def run(self) -> np.ndarray:
        """Of each entry: index of its distinct hash."""
        return np.cumsum(self.new) - 1


def _batches(rows: Iterator[tuple], size: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def ask(docs: DataFrame, questions: Callable[[pa.RecordBatch, int, int], Iterator[tuple]], parts: int, text: str = "text") -> DataFrame:
    """Question and home rows; ``questions(batch, chunk, buckets)`` makes those of one chunk."""
    buckets, at = parts * BUCKETS_EACH, places(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in gathered(batches, text, CHUNK_BYTES):
            for piece in slices(batch, text, CHUNK_BYTES):
                yield from _batches((int(at[row[0] % parts]), *row[1:]) for row in questions(piece, base + n, buckets))
                cluster.release()
                n += 1

    return docs.mapInArrow(cluster.tidy(run), ROWS)


def answer(asked: DataFrame, parts: int, reply: Callable[[list[bytes], list[bytes]], list[np.ndarray]]) -> DataFrame:
    """``reply(keys, more)`` of a bucket, a list item a chunk, gives an array a chunk; home rows pass through."""
    at = places(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def flush() -> Iterator[tuple]:
            if held:
                found = reply([h[1] for h in held], [h[2] for h in held])
                for (chunk, keys, _), a in zip(held, found, strict=True):
                    yield int(at[home(chunk) % parts]), chunk, bucket, keys, a.tobytes(), None

        for batch in batches:
            for i in range(batch.num_rows):
                chunk, here = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if here < 0:
                    yield from _batches(iter([(int(at[home(chunk) % parts]), chunk, here, None, None, batch.column(5)[i].as_py())]))
                    continue
                if here != bucket:
                    yield from _batches(flush())
                    cluster.release()
                    bucket, held = here, []
                held.append((chunk, batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
        yield from _batches(flush())

    return asked.repartition(parts, "place").sortWithinPartitions("bucket", "chunk").mapInArrow(cluster.tidy(run), ROWS)


def collect_home(answered: DataFrame, parts: int, finish: Callable[[Home, np.ndarray, list[tuple[int, bytes]]], pa.RecordBatch], dtype: str, schema: str) -> DataFrame:
    """``finish(home, answers, keys)`` of each chunk: answers (``dtype``) by distinct hash, keys as (bucket, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, home, found, keys = None, None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                here = batch.column(1)[i].as_py()
                if here != chunk:
                    if home is not None:
                        yield finish(Home(home), np.frombuffer(b"".join(found), dtype), keys)
                        cluster.release()
                    chunk, home, found, keys = here, None, [], []
                if batch.column(2)[i].as_py() < 0:
                    home = batch.column(5)[i].as_py()
                else:
                    found.append(batch.column(4)[i].as_py())
                    keys.append((batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
        if home is not None:
            yield finish(Home(home), np.frombuffer(b"".join(found), dtype), keys)

    return answered.repartition(parts, "place").sortWithinPartitions("chunk", "bucket").mapInArrow(cluster.tidy(run), schema)


def reply_shared(keys: list[bytes], more: list[bytes]) -> list[np.ndarray]:
    """1 where a 32-bit key is asked by two chunks, or by one for several documents (``more``: bytes 0 or 1)."""
    sizes = [len(k) // 4 for k in keys]
    _, which, count = np.unique(np.frombuffer(b"".join(keys), "<u4"), return_inverse=True, return_counts=True)
    several = np.bincount(which, np.frombuffer(b"".join(more), np.uint8), len(count)) > 0
    return np.split(((count > 1) | several)[which].astype(np.uint8), np.cumsum(sizes)[:-1])


def reply_classes(keys: list[bytes], more: list[bytes]) -> list[np.ndarray]:
    """Frequency class of a 32-bit key: 0 for one document, else 1 + floor(log2(documents)); ``more``: 32-bit counts."""
    sizes = [len(k) // 4 for k in keys]
    _, which = np.unique(np.frombuffer(b"".join(keys), "<u4"), return_inverse=True)
    total = np.bincount(which, np.frombuffer(b"".join(more), "<u4"))
    classes = np.where(total < 2, 0, 1 + np.floor(np.log2(np.maximum(total, 1)))).astype(np.uint8)
    return np.split(classes[which], np.cumsum(sizes)[:-1])


def reply_earlier(keys: list[bytes], more: list[bytes]) -> list[np.ndarray]:
    """1 where another chunk asked the 128-bit key for a smaller document id (``more``: 64-bit ids)."""
    sizes = [len(k) // 16 for k in keys]
    pairs = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    order, new = _runs(None, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
    ids = np.frombuffer(b"".join(more), "<i8")
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(ids), np.uint8)
    out[order] = least < ids[order]
    return np.split(out, np.cumsum(sizes)[:-1])
