"""Elias-Fano coded monotone sequences over memory-mapped arrays, with vectorised access and search."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
_ONE, _LAST = np.uint64(1), np.uint64(63)
_ODD, _PAIRS, _LOWS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: By 8 * byte + rank: the place of the byte's set bit of that rank.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def save(path: str, arrays: dict[str, np.ndarray]) -> int:
    """One file: a JSON directory, then the arrays at multiples of 8.  Renamed into place, so a repeated task is harmless."""
    directory, at = {}, 0
    for name, a in arrays.items():
        directory[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(directory).encode()
    head += b" " * (-len(head) % 8)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(np.array([len(head)], "<u8").tobytes() + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(temporary, path)
    return 8 + len(head) + at


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    whole = np.memmap(path, np.uint8, "r").view(np.ndarray)
    size = int(whole[:8].view("<u8")[0])
    directory = json.loads(whole[8 : 8 + size].tobytes())
    return {k: whole[8 + size + at : 8 + size + at + n * np.dtype(d).itemsize].view(d) for k, (d, n, at) in directory.items()}


def encode(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of integers below ``universe``."""
    n = len(values)
    values = values.astype(np.uint64)
    low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = np.zeros((n + (universe >> low) + 1) // 64 + 2, np.uint64)
    _put(words, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
    lows = np.zeros(n * low // 64 + 2, np.uint64)
    if low:
        rest = values & np.uint64((1 << low) - 1)
        at = np.arange(n) * low
        shift = (at & 63).astype(np.uint64)
        _put(lows, at >> 6, rest << shift)
        over = np.flatnonzero(shift > 64 - low)
        _put(lows, (at[over] >> 6) + 1, rest[over] >> (np.uint64(64) - shift[over]))
    packed = lows.view(np.uint8)[: -(-n * low // 8)]
    zeros = np.arange(len(words), dtype=np.int64) * 64 - ones
    kind = "<u4" if len(words) < 1 << 26 else "<i8"
    return {f"{name}.meta": np.array([n, low], "<i8"), f"{name}.low": np.concatenate([packed, np.zeros(8, np.uint8)]), f"{name}.high": words, f"{name}.ones": ones.astype(kind), f"{name}.zeros": zeros.astype(kind)}


def _put(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Set bits in the words at these places, which ascend."""
    if len(at):
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[starts]] |= np.bitwise_or.reduceat(bits, starts)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit of each rank in each word: the byte by running counts of all bytes at once, then by a table."""
    rank = rank.astype(np.uint64)
    counts = word - (word >> np.uint64(1) & _ODD)
    counts = (counts & _PAIRS) + (counts >> np.uint64(2) & _PAIRS)
    counts = (counts + (counts >> np.uint64(4)) & _LOWS) * _BYTES
    shift = np.bitwise_count((rank * _BYTES | _TOPS) - counts & _TOPS).astype(np.uint64) << np.uint64(3)
    rest = rank - (counts << np.uint64(8) >> shift & np.uint64(255))
    shift = np.minimum(shift, np.uint64(56))
    byte = word >> shift & np.uint64(255)
    return shift.astype(np.int64) + _IN_BYTE[(byte << np.uint64(3) | rest & np.uint64(7)).astype(np.int64)]


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = (int(x) for x in arrays[f"{name}.meta"])
        self.low, self.high, self.ones, self.zeros = (arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros"))
        self.mask = np.uint64((1 << self.low_bits) - 1)
        self.words = self.low[: len(self.low) & ~7].view("<u8")  # aligned: reads of unaligned integers take several times as long

    def _low(self, i: np.ndarray) -> np.ndarray:
        """Low bits of each element; any value where i is none."""
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        shift = (bit & 63).view(np.uint64)
        bit >>= 6
        out = self.words.take(bit, mode="clip")
        out >>= shift
        bit += 1
        over = self.words.take(bit, mode="clip")
        over <<= _ONE
        np.subtract(_LAST, shift, out=shift)
        over <<= shift
        out |= over
        out &= self.mask
        return out

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        return word * 64 + _select(~self.high[word], k - self.zeros[word].astype(np.int64))

    def _ones_from(self, at: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """Set bits in a row from each bit on, before which lie so many zeros: the elements of one high part."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        window = self.high[word] >> bit
        window |= self.high[word + 1] << _ONE << (_LAST - bit)
        count = np.bitwise_count((window ^ (window + np.uint64(1))) >> np.uint64(1)).astype(np.int64)
        long = np.flatnonzero(count >= 63)
        if len(long):
            count[long] = self._select0(zeros[long]) - at[long]
        return count

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        at = word * 64 + _select(self.high[word], i - self.ones[word].astype(np.int64))
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first element not below the value, whether it is equal); values lie in the universe."""
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        target = values & self.mask
        lo = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) - np.maximum(high - 1, 0), 0)
        size = self._ones_from(lo + high, high)
        some = np.flatnonzero(size)
        at, target = lo[some], target[some]
        # Halving without branches: the place is among ``left`` elements from ``own`` on, if any element is not below.
        active, own, left, sought = slice(None), at.copy(), size[some], target
        while len(left):
            open_ = left > 1
            n = np.count_nonzero(open_)
            if 5 * n < 4 * len(left):  # else it costs less to carry the others along
                at[active] = own
                open_ = np.flatnonzero(open_)
                active = open_ if isinstance(active, slice) else active[open_]
                own, left, sought = own[open_], left[open_], sought[open_]
                if not n:
                    break
            half = left >> 1
            left -= half
            own += half * (self._low(own + half - 1) < sought)
        at[active] = own
        value = self._low(at)
        found = np.zeros(len(values), bool)
        found[some] = value == target
        lo[some] = at + (value < target)
        return lo, found
