"""An n-gram language model in memory-mapped Elias-Fano tries.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; each text ends in one end token.  With unigram
probability p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), the model interpolates hierarchically:

    p2(w | v)    = (c(v w) + M2 p1(w)) / (c(v) + M2)
    p3(w | u v)  = (c(u v w) + M3 p2(w | v)) / (c(u v) + M3)

where c(u v) sums the trigrams that are kept: all, unless a caller asks for those seen ``least_trigram``
times.  Both sum to one over the V known tokens and one unknown.  Counts are gathered by hash from
all training texts into buckets, each of which writes one file of every level to the cluster's
shared folder:

* *words*: sorted hashes and exact counts; a word's id is its place among all.
* *pairs*: words v, their successors w and quantised c(v w) / (c(v) + M2).
* *triples*: words v; successors w of v; contexts u before v, with quantised M3 / (c(u v) + M3); and for
  each context the successors as places among v's successors, with quantised c(u v w) / (c(u v) + M3).

All id lists are monotone (parent number times width plus id) and Elias-Fano coded, as are the pointers;
a query finds w among the successors of v, u among the contexts of v, then w's place among those of
the context.  Words frequent enough to fill a bucket are spread over several by the other word.

Scoring tasks map the files (no task holds a level in its own memory) and sort their queries by
bucket.  The shared folder must be a mounted path (a ``file:`` URL or plain path).

Cases: a null or empty text is its end token alone; no training rows give N = V = 0 and base score 0;
equal texts have equal scores; a null doc_id is never held out; extra columns are not read; a long
text is scored in a slice by itself; no rows give no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import cluster, elias_fano, exchange
from tesselon.llm.wordbytes import gathered, mix64, slices, split_words

M2, M3 = 200.0, 4.0
#: Count from which trigrams are kept, if the caller names none: all are.
LEAST_TRIGRAM = 1
#: Quantised values: 16 bits over log10 from -LOWEST to 0.
LOWEST = 12.0
FOLDS, HELD_OUT = 5, 1
BYTES_A_BUCKET = 16 << 20
SCORE_SLICE = 4 << 20
_END_HASH = int(mix64(np.array([0xE0D], np.uint64))[0])


def quantise(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-np.log10(p) / LOWEST, 0, 1) * 65535).astype("<u2")


_VALUES = 10.0 ** (np.arange(65536) * (-LOWEST / 65535))


def restore(q: np.ndarray) -> np.ndarray:
    return _VALUES[q]


def held_out(doc_id):
    """Whether the remainder of crc32 of the id as text is the held-out fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct tokens, the number of each token (end tokens among them), and each text's first token (one more at the end)."""
    words = split_words(texts)
    codes, names = words.coded(lower=True)
    every = np.append(names[:, 0], np.uint64(_END_HASH))
    order = np.argsort(every)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    which = np.insert(place[codes], words.first[1:], place[-1])
    return every[order], which, words.first + np.arange(len(words.first))


# -- level 1: words -----------------------------------------------------------------------------------


def _word_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of a task's words, by bucket; held back and merged up to a million distinct ones."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            words, counts = _merge(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
            place = _word_bucket(words, buckets)
            cuts = np.searchsorted(place, np.arange(buckets + 1)).tolist()
            rows = [(b, words[x:y].tobytes(), counts[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "counts"])

    for batch in gathered(batches, "text", SCORE_SLICE):
        for piece in slices(batch, "text"):
            unique, which, _ = token_hashes(piece.column("text"))
            held.append((unique, np.bincount(which, minlength=len(unique))))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [_merge(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from flush()
                    held, size = [], 0
    yield from flush()


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that buckets in order are words in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows sorted by bucket: (bucket, for each column the list of blobs)."""
    bucket, held = None, []
    for batch in batches:
        for row in zip(batch.column("bucket").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != bucket:
                if held:
                    yield bucket, [list(c) for c in zip(*held, strict=True)]
                bucket, held = row[0], []
            held.append(row[1:])
    if held:
        yield bucket, [list(c) for c in zip(*held, strict=True)]


class Words:
    """Level 1, mapped: ids and counts of words."""

    def __init__(self, folder: str, offsets: list[int], total: int):
        self.folder, self.offsets, self.total = folder, np.array(offsets, np.int64), total
        self.size = int(offsets[-1])
        self.buckets = len(offsets) - 1

    def _file(self, bucket: int) -> dict[str, np.ndarray]:
        return _mapped(f"{self.folder}/words-{bucket}")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unknown: the number of words) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), self.size, np.int64), np.zeros(len(hashes), np.int64)
        place = _word_bucket(hashes, self.buckets)
        cuts = np.searchsorted(place, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            if self.offsets[b + 1] == self.offsets[b]:
                continue
            file, own = self._file(b), slice(cuts[b], cuts[b + 1])
            at = np.searchsorted(file["hash"], hashes[own])
            at = np.minimum(at, len(file["hash"]) - 1)
            known = file["hash"][at] == hashes[own]
            ids[own] = np.where(known, at + self.offsets[b], self.size)
            counts[own] = np.where(known, file["count"][at], 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.offsets)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            out[cuts[b] : cuts[b + 1]] = self._file(b)["count"][ids[cuts[b] : cuts[b + 1]] - self.offsets[b]]
        return out

    @property
    def start(self) -> int:
        """Id of the context before a text."""
        return self.size + 1

    @property
    def width(self) -> int:
        return self.size + 2


@lru_cache(4096)
def _mapped(path: str) -> dict[str, np.ndarray]:
    return elias_fano.load(path)


# -- levels 2 and 3 -----------------------------------------------------------------------------------


class Spread:
    """Bucket of (v, x): a hash of v, and for frequent v of x too."""

    def __init__(self, buckets: int, hot: dict[int, int]):
        self.buckets = buckets
        self.ids = np.array(sorted(hot), np.int64)
        self.ways = np.array([hot[i] for i in sorted(hot)], np.int64)

    def bucket(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        salt = np.zeros(len(v), np.uint64)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, v), len(self.ids) - 1)
            hot = np.flatnonzero(self.ids[at] == v)
            salt[hot] = mix64(x[hot].astype(np.uint64)) % self.ways[at[hot]].astype(np.uint64)
        return (mix64(v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(self.buckets)).astype(np.int64)


def _contexts(ids: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the one before that; ``start`` before a text's first."""
    v, u = np.empty_like(ids), np.empty_like(ids)
    v[1:], u[2:] = ids[:-1], ids[:-2]
    heads = first[:-1]
    v[heads], u[heads] = start, start
    second = heads[np.diff(first) > 1] + 1
    u[second] = start
    return u, v


def _one_key(*keys: np.ndarray) -> np.ndarray | None:
    """One integer a row, in the rows' lexical order; None if the ranges of these non-negative integers don't allow it."""
    packed, room = keys[0], int(keys[0].max(initial=0)) + 1
    for k in keys[1:]:
        size = int(k.max(initial=0)) + 1
        room *= size
        if room >= 1 << 63:
            return None
        packed = packed * size + k
    return packed


def _ordered(*keys: np.ndarray) -> np.ndarray:
    """Lexical order of rows of non-negative integers."""
    packed = _one_key(*keys)
    return np.lexsort(keys[::-1]) if packed is None else np.argsort(packed)


def _by_bucket(place: np.ndarray, buckets: int) -> np.ndarray:
    """A stable order by bucket; small integers are sorted by their digits."""
    return np.argsort(place.astype(np.uint16) if buckets <= 1 << 16 else place, kind="stable")


def _count_rows(keys: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in lexical order, and how often each occurs."""
    packed = _one_key(*keys)
    if packed is None:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        starts = _runs(*keys)
        return [k[starts] for k in keys], np.diff(np.append(starts, len(order)))
    packed.sort()
    starts = _runs(packed)
    count, rest, columns = np.diff(np.append(starts, len(packed))), packed[starts], []
    for k in keys[:0:-1]:
        rest, column = np.divmod(rest, int(k.max(initial=0)) + 1)
        columns.append(column)
    return [rest, *columns[::-1]], count


def _packed(columns: list[np.ndarray]) -> bytes:
    """32-bit columns, the first as differences, byte planes apart, compressed."""
    n = len(columns[0])
    planes = [np.diff(c, prepend=c[:1]) if i == 0 else c for i, c in enumerate(columns)]
    head = np.array([n, int(columns[0][0]) if n else 0], "<i8").tobytes()
    raw = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in planes)
    return head + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    n, base = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    raw = np.frombuffer(pa.decompress(blob[16:], 4 * n * columns, "zstd", asbytes=True), np.uint8).reshape(columns, 4, n)
    out = [np.ascontiguousarray(c.T).view("<u4")[:, 0].astype(np.int64) for c in raw]
    out[0] = np.cumsum(out[0]) + base
    return out


def _gram_rows(batches: Iterator[pa.RecordBatch], words: Words, spread: Spread) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, "text", SCORE_SLICE):
        for piece in slices(batch, "text", SCORE_SLICE):
            unique, which, first = token_hashes(piece.column("text"))
            ids = np.append(words.find(unique)[0], words.start)
            u, v = _contexts(which, first, len(unique))  # numbers within the slice are small, and ascend as ids do
            rows = []
            found, count = _count_rows((v, which, u))
            v, w, u = (ids[x] for x in found)
            pair = _runs(v, w)  # one sort serves both levels
            both = ((2, [v[pair], w[pair]], np.add.reduceat(count, pair)), (3, [v, u, w], count))
            for kind, found, count in both:
                place = spread.bucket(found[0], found[1])
                order = _by_bucket(place, spread.buckets)
                cuts = np.searchsorted(place[order], np.arange(spread.buckets + 1)).tolist()
                for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if y > x:
                        own = order[x:y]
                        rows.append((2 * b + kind - 2, _packed([*(c[own] for c in found), count[own]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], names=["bucket", "keys"])


def _summed(blobs: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [_unpacked(b, width + 1) for b in blobs]
    columns = [np.concatenate([p[i] for p in parts]) for i in range(width + 1)]
    runs = _runs(columns[0])  # a bucket has few of all first ids, so their ranks leave room for the others
    rank = np.repeat(np.unique(columns[0][runs], return_inverse=True)[1], np.diff(np.append(runs, len(columns[0]))))
    packed = _one_key(rank, *columns[1:width])
    if packed is None:
        order = np.lexsort(columns[width - 1 :: -1])
        starts = _runs(*(c[order] for c in columns[:width]))
    else:
        order = np.argsort(packed)
        starts = _runs(packed[order])
    first = order[starts]
    return [c[first] for c in columns[:width]], np.add.reduceat(columns[width][order], starts)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pair_arrays(v: np.ndarray, w: np.ndarray, count: np.ndarray, of_v: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Level 2 of one bucket from rows in order of (v, w); ``of_v``: c(v) of each row."""
    starts = _runs(v)
    parent = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(v))))
    return elias_fano.encode("v", v[starts], width) | elias_fano.encode("vw", parent * width + w, len(starts) * width) | {"q": quantise(count / (of_v + M2))}


def triple_arrays(v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, width: int, least_trigram: int = LEAST_TRIGRAM) -> dict[str, np.ndarray]:
    """Level 3 of one bucket from rows in order of (v, u, w)."""
    kept = count >= least_trigram
    v, u, w, count = v[kept], u[kept], w[kept], count[kept]
    starts = _runs(v)
    parent = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(v))))
    successors = np.unique(parent * width + w)
    begin = np.searchsorted(successors, np.arange(len(starts) + 1) * width)  # of each v's successors
    contexts = _runs(v, u)
    context = np.repeat(np.arange(len(contexts)), np.diff(np.append(contexts, len(v))))
    of_context = parent[contexts]
    room = np.diff(begin)[of_context]
    base = np.cumsum(room) - room
    place = np.searchsorted(successors, parent * width + w) - begin[parent]
    total = np.add.reduceat(count, contexts) if len(contexts) else np.zeros(0, np.int64)
    return (
        elias_fano.encode("v", v[starts], width)
        | elias_fano.encode("begin", begin, len(successors) + 1)
        | elias_fano.encode("vw", successors, len(starts) * width)
        | elias_fano.encode("vu", of_context * width + u[contexts], len(starts) * width)
        | elias_fano.encode("base", base, int(room.sum()) + 1)
        | elias_fano.encode("places", base[context] + place, int(room.sum()) + 1)
        | {"back": quantise(M3 / (total + M3)), "q": quantise(count / (total[context] + M3))}
    )


def _local(folder: str) -> str:
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"tries are memory-mapped, so {folder} must be a mounted path")
    return url.path


class Model:
    """The levels' folder, the words and the dealing of pairs; small enough to send with a task."""

    def __init__(self, words: Words, spread: Spread):
        self.words, self.spread = words, spread
        self.floor = words.total + 0.5 * (words.size + 1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / self.floor

    def probabilities(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, c_v: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """p3 of each query; ``c_v``: count of v as a context."""
        p = M2 / (c_v + M2) * p1
        for level in (2, 3):
            place = self.spread.bucket(v, w if level == 2 else u)
            order = _by_bucket(place, self.spread.buckets)
            cuts = np.searchsorted(place[order], np.arange(self.spread.buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                path = f"{self.words.folder}/level{level}-{b}"
                if not _exists(path):
                    continue
                own = order[cuts[b] : cuts[b + 1]]
                (self._pairs if level == 2 else self._triples)(_level(path, level), own, u, v, w, p)
        return p

    def _pairs(self, level, own, u, v, w, p) -> None:
        parents, pairs, q = level
        own, at = _found(parents, own, v)
        place, found = pairs.find(at * self.words.width + w[own])
        p[own[found]] += restore(q[place[found]])

    def _triples(self, level, own, u, v, w, p) -> None:
        parents, begin, successors, contexts, base, places, back, q = level
        own, at = _found(parents, own, v)
        key = np.empty(len(u), np.int64)
        key[own] = at * self.words.width + u[own]
        parent = np.empty(len(u), np.int64)
        parent[own] = at
        own, context = _found(contexts, own, key)
        at = parent[own]
        if not len(own):
            return
        p[own] *= restore(back[context])
        place, found = successors.find(at * self.words.width + w[own])
        own, at, context, place = own[found], at[found], context[found], place[found]
        if not len(own):
            return
        at, found = places.find(base.access(context) + place - begin.access(at))
        p[own[found]] += restore(q[at[found]])


def _found(sequence: elias_fano.Sequence, own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``own`` whose value the sequence holds, and its place; equal values in a row are sought once."""
    if not len(own):
        return own, own
    sought = values[own]
    starts = _runs(sought)
    at, known = sequence.find(sought[starts])
    sizes = np.diff(np.append(starts, len(own)))
    known = np.repeat(known, sizes)
    return own[known], np.repeat(at, sizes)[known]


@lru_cache(65536)
def _exists(path: str) -> bool:
    return os.path.exists(path)


@lru_cache(4096)
def _level(path: str, level: int):
    arrays = _mapped(path)
    if level == 2:
        return elias_fano.Sequence(arrays, "v"), elias_fano.Sequence(arrays, "vw"), arrays["q"]
    return *(elias_fano.Sequence(arrays, n) for n in ("v", "begin", "vw", "vu", "base", "places")), arrays["back"], arrays["q"]


def train(texts: DataFrame, least_trigram: int = LEAST_TRIGRAM) -> Model:
    """Build the levels from the texts (one column, ``text``)."""
    spark = texts.sparkSession
    buckets = cluster.parts_for(spark, cluster.text_bytes(texts), BYTES_A_BUCKET)
    folder = _local(cluster.new_path(spark, "trie"))
    os.makedirs(folder, exist_ok=True)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _word_rows(batches, buckets)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (keys, counts) in _grouped(batches, ("keys", "counts")):
            found, count = _merge(np.frombuffer(b"".join(keys), "<u8"), np.frombuffer(b"".join(counts), "<i8"))
            elias_fano.save(f"{folder}/words-{bucket}", {"hash": found, "count": count})
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([int(count.sum())], pa.int64())], names=["bucket", "n", "total"])

    packed = texts.select("text").mapInArrow(cluster.tidy(words_of), "bucket int, keys binary, counts binary")
    written = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(cluster.tidy(write_words), "bucket int, n long, total long").collect()  # one row a bucket
    sizes = {r["bucket"]: r["n"] for r in written}
    offsets = [0, *np.cumsum([sizes.get(b, 0) for b in range(buckets)]).tolist()]
    words = Words(folder, offsets, sum(r["total"] for r in written))

    # At most 2 * buckets words are as frequent as half a bucket's share of all tokens.
    share = max(1.0, words.total / (2 * buckets))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                if sizes.get(b):
                    count = words._file(b)["count"]
                    at = np.flatnonzero(count >= share)
                    yield pa.RecordBatch.from_arrays([pa.array(at + offsets[b]), pa.array(count[at])], names=["id", "count"])

    hot = {r["id"]: int(np.ceil(r["count"] / share)) for r in spark.range(buckets).mapInArrow(cluster.tidy(frequent), "id long, count long").collect()}
    texts_read = words.find(np.array([_END_HASH], np.uint64))[1][0] if words.size else 0
    if texts_read >= share:
        hot[words.start] = int(np.ceil(texts_read / share))
    spread = Spread(buckets, hot)

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gram_rows(batches, words, spread)

    def write_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, (blobs,) in _grouped(batches, ("keys",)):
            bucket, kind = place // 2, place % 2 + 2
            if kind == 2:
                (v, w), count = _summed(blobs, 2)
                starts = _runs(v)
                of_v = np.repeat(_context_counts(words, v[starts]), np.diff(np.append(starts, len(v))))
                arrays = pair_arrays(v, w, count, of_v, words.width)
            else:
                (v, u, w), count = _summed(blobs, 3)
                arrays = triple_arrays(v, u, w, count, words.width, least_trigram)
            size = elias_fano.save(f"{folder}/level{kind}-{bucket}", arrays)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([len(arrays["q"])], pa.int64()), pa.array([size], pa.int64())], names=["level", "n", "bytes"])

    packed = texts.select("text").mapInArrow(cluster.tidy(grams_of), "bucket int, keys binary")
    packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(cluster.tidy(write_levels), "level int, n long, bytes long").groupBy("level").agg(F.sum("n"), F.sum("bytes")).collect()
    return Model(words, spread)


def _context_counts(words: Words, v: np.ndarray) -> np.ndarray:
    """How often each of the sorted ids stands before a token."""
    out = np.zeros(len(v), np.int64)
    inner = v < words.size
    out[inner] = words.counts(v[inner])
    if words.size and (v == words.start).any():
        out[v == words.start] = words.find(np.array([_END_HASH], np.uint64))[1][0]
    return out


def score(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of each row of doc_id, held_out and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.words
        start_count = words.find(np.array([_END_HASH], np.uint64))[1][0] if words.size else 0
        for batch in gathered(batches, "text", SCORE_SLICE):
            for piece in slices(batch, "text", SCORE_SLICE):
                unique, which, first = token_hashes(piece.column("text"))
                ids, counts = words.find(unique)
                c, p1 = counts[which], model.unigram(counts)
                u, v = _contexts(which, first, len(unique))  # numbers within the slice, which are small
                key = _ordered(v, u, which)
                starts = _runs(v[key], u[key], which[key])
                one = key[starts]
                u, v, w = u[one], v[one], which[one]
                ids, of = np.append(ids, words.start), np.append(counts, start_count)
                p = model.probabilities(ids[u], ids[v], ids[w], of[v], p1[w])
                logs = np.empty(len(key))
                logs[key] = np.repeat(np.log10(p), np.diff(np.append(starts, len(key))))
                base = np.add.reduceat(np.log10(p1)[which], first[:-1])
                total = np.add.reduceat(logs, first[:-1])
                known = np.add.reduceat((c > 0).astype(np.int64), first[:-1])
                columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(len(base), words.total)), pa.array(base), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.select("doc_id", "held_out", "text").mapInArrow(cluster.tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scored(docs: DataFrame, least_trigram: int = LEAST_TRIGRAM) -> DataFrame:
    """Train on all folds but the held-out one and score every row."""
    cluster.small_batches(docs.sparkSession)
    own = F.col("doc_id").cast("long")
    texts = docs.select(own.alias("doc_id"), held_out(own).alias("held_out"), "text")
    return score(texts, train(texts.filter("not held_out"), least_trigram))
