"""Vectorised word handling over Arrow string columns.

Texts stay UTF-8 bytes in one numpy buffer per slice; words are byte ranges.  Within a slice Arrow's
dictionary encoding tells them apart by their bytes; beyond it a word has two 64-bit names
(``digests``: BLAKE2b halves unless it is short), made once for each distinct word of a slice, so no
text can be made whose words are mistaken for others.  Every helper takes the slice as the unit of memory: ``slices`` cuts
a record batch at ``max_bytes`` of text (a longer single text is a slice by itself).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))[:-1]]) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: str, bytes_each: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive batches joined until they hold ``bytes_each`` of text."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= bytes_each:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[buf]


def coded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Ascending byte ranges that don't overlap: (number of each range's content, the distinct contents)."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    data = buf[start[0] : end[-1]]
    if offsets[-1] != len(data):
        step = np.zeros(len(data) + 1, np.int8)
        step[start - start[0]] = 1
        step[end - start[0]] -= 1
        data = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def digests(contents: pa.Array) -> np.ndarray:
    """Two 64-bit names of each content, one a column.

    Up to eight bytes are one integer, which is scrambled and added to the result, so that it can't be
    had back from its name; longer contents have the halves of their BLAKE2b digests.
    """
    contents = contents.cast(pa.large_binary())
    n = len(contents)
    out = np.empty((n, 2), np.uint64)
    if not n:
        return out
    _, offsets, data = contents.buffers()
    offsets = np.frombuffer(offsets, np.int64)[contents.offset : contents.offset + n + 1]
    size = np.diff(offsets)
    short = np.flatnonzero(size <= 8)
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    octets = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,), writeable=False)
    own = size[short].astype(np.uint64)
    value = octets[offsets[short]] & (_ALL >> (np.uint64(8) * (np.uint64(8) - np.maximum(own, np.uint64(1)))))
    value[own == 0] = 0
    for half, key in enumerate((np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))):
        keyed = value ^ mix64(key + own * _MULT)
        out[short, half] = mix64(mix64(keyed) * _MULT + keyed) + keyed
    long = np.flatnonzero(size > 8)
    if len(long):
        blake = hashlib.blake2b
        out[long] = np.frombuffer(b"".join([blake(x, digest_size=16).digest() for x in contents.take(pa.array(long)).to_pylist()]), "<u8").reshape(-1, 2)
    return out


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each byte range (as for ``coded``)."""
    codes, contents = coded(buf, start, end)
    return digests(contents)[codes, 0]


@dataclass
class Words:
    buf: np.ndarray
    offsets: np.ndarray  # of the documents, in bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each document: index of its first word; one more at the end
    _coded: dict = field(default_factory=dict)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def coded(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, names of the distinct words); A-Z count as a-z if ``lower``."""
        if lower not in self._coded:
            codes, contents = coded(lowered(self.buf) if lower else self.buf, self.start, self.end)
            self._coded[lower] = codes, digests(contents)
        return self._coded[lower]

    def hashes(self, lower: bool, half: int = 0) -> np.ndarray:
        codes, names = self.coded(lower)
        return names[codes, half]


def edges(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that no document boundary crosses."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = member.copy()
    begin[1:] &= ~member[:-1]
    stop = member.copy()
    stop[:-1] &= ~member[1:]
    lo, hi = offsets[:-1], offsets[1:]
    some = hi > lo
    begin[lo[some]] = member[lo[some]]
    stop[hi[some] - 1] = member[hi[some] - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def split_words(texts: pa.Array) -> Words:
    """Words are maximal runs of bytes other than 0x20 and 0x09-0x0D."""
    buf, offsets = flat(texts)
    start, end = edges(~_SPACE[buf], offsets)
    return Words(buf, offsets, start, end, np.searchsorted(start, offsets))


def gram_hashes(words: np.ndarray, n: int, at: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hashes of the n consecutive word names that begin at each of the positions ``at``.

    Each step multiplies and folds the high bits back, so the hash is no linear function of the names.
    """
    out = np.full(len(at), mix64(np.array([2 * seed + 7], np.uint64))[0])
    for k in range(n):
        out ^= words[at + k]
        out *= _MULT
        out ^= out >> np.uint64(32)
    return mix64(out)


def gram_positions(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, word index) of every n-gram that lies in one document."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return doc, at
