"""Ids of text segments that a tokenizer treats independently, each distinct one encoded once per slice or less."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct segments remembered by a worker (about 100 MB); beyond that it starts afresh.
CACHE_ENTRIES = 300_000
#: Segments that are encoded as one string, with a special token between them.
TOGETHER = 256
#: Words of letters that normalizers leave letters: each is one pre-token of a tokenizer that marks word ends.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


class SegmentCache:
    """Maps byte strings to token ids by a tokenizer; a copy of it has ``mark`` as a special token.

    What is known is kept under the bytes themselves, never under a hash of them.
    """

    def __init__(self, tokenizer, mark: str, as_text: bool = False):
        self.tokenizer, self.mark, self.as_text = tokenizer, mark, as_text
        self.marked = type(tokenizer).from_str(tokenizer.to_str())
        self.marked.add_special_tokens([mark])
        self.mark_id = self.marked.token_to_id(mark)
        self.known: dict[bytes, bytes] = {}
        self.texts: dict[bytes, str] = {}

    def _encode(self, segments: list[str]) -> list[list[int]]:
        odd = [i for i, s in enumerate(segments) if self.mark in s]
        plain = segments
        if odd:
            plain = list(segments)
            for i in odd:
                plain[i] = ""
        joined = [self.mark.join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]
        out: list[list[int]] = []
        for n, found in enumerate(self.marked.encode_batch_fast(joined, add_special_tokens=False)):
            ids, at = found.ids, 0
            cuts = np.flatnonzero(np.array(ids, np.int64) == self.mark_id).tolist()
            if len(cuts) + 1 != len(plain[n * TOGETHER : (n + 1) * TOGETHER]):
                raise ValueError("the mark was not kept as one token")
            for cut in [*cuts, len(ids)]:
                out.append(ids[at:cut])
                at = cut + 1
        for i in odd:
            out[i] = self.tokenizer.encode(segments[i], add_special_tokens=False).ids
        return out

    def _learn(self, segments: list[bytes]) -> None:
        """Remember the ids of new segments, and their decimal text."""
        found = self._encode([s.decode() for s in segments])
        cuts = (np.cumsum([0, *map(len, found)]) * 4).tolist()
        raw = np.fromiter((x for f in found for x in f), "<u4", cuts[-1] // 4).tobytes()
        self.known.update((k, raw[x:y]) for k, x, y in zip(segments, cuts, cuts[1:], strict=False))
        if self.as_text:
            self.texts.update((k, " ".join(map(str, f))) for k, f in zip(segments, found, strict=True))

    def ids(self, codes: np.ndarray, contents: pa.Array):
        """(ids of all segments in order, token count of each segment, text of each segment's ids or None); segments as ``wordbytes.coded`` gives them."""
        keys = contents.to_pylist()
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.texts = {}, {}
        new = [k for k in keys if k not in self.known]
        if new:
            self._learn(new)
        parts = [self.known[k] for k in keys]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        begin = np.cumsum(sizes) - sizes
        texts = None
        if self.as_text:
            own = np.array([self.texts[k] for k in keys] + [None], object)[:-1]
            texts = own[codes]
        return *_spread(pool, begin[codes], sizes[codes]), texts


def _spread(pool: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` that begin there and have these lengths, one after the other, and the lengths."""
    where = np.arange(int(counts.sum())) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    return pool[where], counts


#: Words that ``WordCache`` remembers: about 150 bytes each.
WORDS = 350_000


class WordCache(SegmentCache):
    """The same for a tokenizer that marks word ends: ids lie in one pool, the words are numbered.

    Words of letters are encoded together with spaces between them and told apart by ``word_end``,
    the suffix of tokens that end a word.
    """

    def __init__(self, tokenizer, mark: str, word_end: str):
        super().__init__(tokenizer, mark)
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(word_end)]] = True
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def _append(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, segments: list[bytes]) -> None:
        begin, size = np.full(len(segments), -1), np.zeros(len(segments), np.int32)
        shown = [s.decode() for s in segments]
        plain = [i for i, s in enumerate(shown) if LETTERS.fullmatch(s)]
        for a in range(0, len(plain), 8 * TOGETHER):
            part = plain[a : a + 8 * TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([shown[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if len(cuts) == len(part) + 1:  # else the words are encoded one by one below
                begin[part] = self._append(ids) + cuts[:-1]
                size[part] = np.diff(cuts)
        rest = np.flatnonzero(begin < 0).tolist()
        for i, found in zip(rest, self._encode([shown[i] for i in rest]), strict=True):
            begin[i], size[i] = self._append(np.array(found, "<u4")), len(found)
        self.number.update(zip(segments, range(len(self.begin), len(self.begin) + len(segments)), strict=True))
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])

    def ids(self, codes: np.ndarray, contents: pa.Array):
        keys = contents.to_pylist()
        if len(self.number) > WORDS:
            self._reset()
        new = [k for k in keys if k not in self.number]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        return *_spread(self.pool, self.begin[at][codes], self.size[at].astype(np.int64)[codes]), None
