"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file names byte strings.  The library's BPE model works on characters, so bytes are mapped
to printable characters (printable Latin-1 stays itself, the rest follow from U+0100), and merges
are recovered from the ranks: each string of rank r was merged from the two parts that the merges
of lower rank leave of it.  Texts are cut where the pre-tokenizing pattern cuts in any context
(around ASCII white space), each distinct segment is encoded once per slice, and ids are gathered.
Decoding looks ids up in the byte table and joins bytes, so a character that tokens split comes
back whole; ``decode_pieces`` does so for a stream, holding incomplete characters back.

Cases: null or empty texts have no ids; equal rows give equal rows; a text that holds other than
ASCII white space is encoded as one segment; a very long text is a slice by itself; no rows give no
rows; further columns are kept by ``encode`` only if listed, so their names can't clash.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesselon.llm.cluster import small_batches, tidy
from tesselon.llm.token_cache import SegmentCache
from tesselon.llm.wordbytes import _SPACE, coded, edges, flat, gathered, slices

#: White space beyond ASCII, and the controls that some libraries count as such, in UTF-8.
ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xe1\xa0\x8e|\xe2\x80\x8b|\xef\xbb\xbf")


#: Stands between segments that are encoded together; no segment holds a space between other characters, unless odd.
MARK = "\n<mark> \n"
#: Text whose distinct segments are looked up together.
TOGETHER_BYTES = 4 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank else rank)
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


@lru_cache(4)
def tokenizer_json(path: str, pattern: str) -> str:
    """The library's own description of the tokenizer that the rank file and the pattern define."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    named = lambda raw: "".join(chars[b] for b in raw)
    model = models.BPE({named(t): r for t, r in ranks.items()}, [(named(a), named(b)) for a, b in merges_of(ranks)], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


@lru_cache(4)
def _codec(json: str) -> tuple[SegmentCache, list[bytes]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json)
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocab.values()) + 1)
    for name, i in vocab.items():
        table[i] = bytes(back[c] for c in name)
    return SegmentCache(tokenizer, MARK, as_text=True), table


def segments(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of segments that are encoded independently: a word with the one space before it, or the white space left."""
    start, end = edges(~_SPACE[buf], offsets)
    lo, hi = offsets[:-1], offsets[1:]
    doc = np.searchsorted(offsets, start, "right") - 1
    run = offsets[doc]
    if len(start) > 1:
        run[1:] = np.maximum(run[1:], end[:-1])
    gap = start > run
    spaced = gap & (buf[np.maximum(start - 1, 0)] == 32)
    tail = end[end < offsets[doc + 1]] if len(end) else end
    cuts = np.unique(np.concatenate([lo[hi > lo], start - spaced, run[gap], start[gap & ~spaced] - 1, tail]))
    odd = [m.start() for m in ODD_SPACE.finditer(buf.tobytes())]
    if odd:
        whole = np.zeros(len(lo), bool)
        whole[np.searchsorted(offsets, odd, "right") - 1] = True
        own = np.searchsorted(offsets, cuts, "right") - 1
        cuts = cuts[~whole[own] | (cuts == offsets[own])]
    return cuts


def encode_array(texts: pa.Array, json: str):
    """(ids, count of each text, text of each segment's ids, segments of each text as offsets)."""
    buf, offsets = flat(texts)
    cuts = segments(buf, offsets)
    ends = np.append(cuts[1:], len(buf)) if len(cuts) else cuts
    ids, counts, shown = _codec(json)[0].ids(*coded(buf, cuts, ends))
    of_doc = np.searchsorted(cuts, offsets)
    upto = np.concatenate([[0], np.cumsum(counts)])[of_doc]
    return ids, np.diff(upto), shown, of_doc


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """``keep`` columns, ids, and byte_ends: where each token ends in the UTF-8 text (a token may end inside a character)."""
    json = tokenizer_json(ranks_path, pattern)
    kept = docs.select(*keep, docs[column].alias("_text"))
    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("byte_ends", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _codec(json)[1]
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        for batch in batches:
            for piece in slices(batch, "_text"):
                ids, counts, _, _ = encode_array(piece.column("_text"), json)
                at = np.concatenate([[0], np.cumsum(counts)])
                ends = np.cumsum(sizes[ids])
                ends = ends - np.repeat(np.concatenate([[0], ends])[at[:-1]], counts)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (ids.astype(np.int32), ends)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *lists], names=[*keep, "ids", "byte_ends"])

    return kept.mapInArrow(tidy(run), schema)


def decode_bytes(ids: Iterable[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def decode_pieces(ids: Iterable[int], table: list[bytes]) -> Iterator[str]:
    """Text for each token as it comes; the bytes of a split character wait for their last token."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield decoder.decode(table[i])
    yield decoder.decode(b"", final=True)


def byte_table(ranks_path: str, pattern: str) -> list[bytes]:
    return _codec(tokenizer_json(ranks_path, pattern))[1]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces) and decoded_sha256 (of the decoded bytes)."""
    json = tokenizer_json(ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _codec(json)[1]
        for batch in gathered(batches, "text", TOGETHER_BYTES):
            for piece in slices(batch, "text", TOGETHER_BYTES):
                ids, counts, shown, of_doc = encode_array(piece.column("text"), json)
                at = np.concatenate([[0], np.cumsum(counts)]).tolist()
                of_doc = of_doc.tolist()
                ids_sha, text_sha = [], []
                for i in range(len(counts)):
                    ids_sha.append(hashlib.sha256(" ".join(shown[of_doc[i] : of_doc[i + 1]].tolist()).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decode_bytes(ids[at[i] : at[i + 1]].tolist(), table)).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
