"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its lower-cased words (weight: how often each occurs).  For each
of K samples every word draws r and c from Gamma(2, 1) and b from U(0, 1), all from hashes of the
word and the sample's number; with t = floor(ln(weight) / r + b) the sample is the (word, t) of
least c * exp(-r * (t - b + 1)).  Two documents agree in a sample with probability equal to
their generalised Jaccard similarity, sum of minima over sum of maxima of the weights.
A fingerprint writes 16 bits a sample, so ``likeness`` is biased upwards by 2**-16 at most.

Cases: a null, empty or wordless text is the set of one pseudo-word, so such texts agree with each
other and with nothing else; equal texts have equal fingerprints; ties in the minimum fall to the
smaller sample hash; a very long text is sampled in blocks of its words; a repeated row is followed
by its copy; no rows give no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.cluster import parts_for, place_among, small_batches, tidy
from tesselon.llm.wordbytes import mix64, slices, split_words

SAMPLES = 64
#: Entries a block: with 64 samples of 8 bytes each, a block stays in a processor's cache.
BLOCK = 2_000
SLICE = 2 << 20
_EMPTY = np.uint64(0x5DEECE66D)


def _uniforms(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from the halves of each 64-bit value."""
    scale = 2.0**-32
    return ((seeds >> np.uint64(32)).astype(np.float64) + 0.5) * scale, ((seeds & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * scale


def sample_table(words: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """For each (word, weight) and sample: ln of the sample value as ordered 32 bits, then 32 bits of a hash of (word, t)."""
    salt = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = words[:, None] ^ salt[None, :]
    u1, u2 = _uniforms(mix64(base))
    u3, u4 = _uniforms(mix64(base + np.uint64(1)))
    b = _uniforms(mix64(base + np.uint64(2)))[0]
    r = -np.log(u1 * u2)
    t = np.floor(np.log(weights)[:, None] / r + b)
    value = (np.log(-np.log(u3 * u4)) - r * (t - b + 1)).astype(np.float32)
    bits = value.view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    name = mix64(base + t.astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
    return ordered << np.uint64(32) | name


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """16-bit samples (texts x samples)."""
    words = split_words(texts)
    n = len(words.first) - 1
    which, unique = words.coded(lower=True)
    unique = unique[:, 0]
    key, weight = np.unique(words.doc * max(len(unique), 1) + which, return_counts=True)
    doc, which = np.divmod(key, max(len(unique), 1))
    pair, of_pair = np.unique(which << 32 | weight, return_inverse=True)
    least = np.full((n, samples), np.uint64(0xFFFFFFFFFFFFFFFF))
    empty = np.diff(words.first) == 0
    if empty.any():
        least[empty] = sample_table(np.array([_EMPTY]), np.array([1.0]), samples)
    if len(doc):
        # Few distinct (word, weight) pairs make up most entries: each is sampled once a slice.
        table = np.empty((len(pair), samples), np.uint64)
        for a in range(0, len(pair), BLOCK):
            part = pair[a : a + BLOCK]
            table[a : a + BLOCK] = sample_table(unique[part >> 32], (part & 0xFFFFFFFF).astype(np.float64), samples)
        for a in range(0, len(doc), BLOCK):
            own = doc[a : a + BLOCK]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            found = np.minimum.reduceat(table[of_pair[a : a + BLOCK]], starts, axis=0)
            least[own[starts]] = np.minimum(least[own[starts]], found)  # a block's documents differ
    return (least & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def hex_rows(signs: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signs]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document in descending doc_id.

    The next document is found without gathering all rows in one place: rows are dealt to ranges of
    doc_id, and the greatest row of each range is copied to the end of the range above it (of the
    first range: to the end of the last).  Equal doc_ids are ordered by text; null ids come last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    least = -(1 << 63)
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(least)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 2 * parts_for(spark, int(size), 64 << 20)
    probs = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("key", probs, max(20_000, 20 * ranges))).first()[0] or [])) if probs else []
    rows = rows.withColumn("band", F.lit(len(bounds)) - place_among(F.col("key"), bounds))  # 0 holds the greatest ids
    heads = {r["band"]: r["key"] for r in rows.groupBy("band").agg(F.max("key").alias("key")).collect()}  # one row a range
    present = sorted(heads)
    if not present:
        present, heads = [0], {0: 0}
    above = {b: present[i - 1] for i, b in enumerate(present)}  # the first's copy goes to the last
    copies = F.create_map(*[F.lit(x) for b in present for x in (b, above[b])])
    tops = F.create_map(*[F.lit(x) for b in present for x in (b, heads[b])])
    copied = F.when(F.col("key") == tops[F.col("band")], F.array(F.struct(F.col("band").alias("to"), F.lit(0).alias("copy")), F.struct(copies[F.col("band")].alias("to"), F.lit(1).alias("copy"))))
    dealt = rows.withColumn("place", F.explode(F.coalesce(copied, F.array(F.struct(F.col("band").alias("to"), F.lit(0).alias("copy")))))).select("doc_id", "text", "key", F.col("place.to").alias("band"), F.col("place.copy").alias("copy"))
    dealt = dealt.withColumn("tie", F.xxhash64("text")).repartitionByRange(len(present), "band").sortWithinPartitions("band", "copy", F.desc("key"), "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the one after it
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                ids, texts, bands, copy = (piece.column(i).to_pylist() for i in range(4))
                if held is not None:
                    ids, texts, bands, copy = [held[0], *ids], [held[1], *texts], [held[2], *bands], [held[3], *copy]
                held = ids[-1], texts[-1], bands[-1], copy[-1]
                yield from _pairs(ids, texts, copy, samples)

    return dealt.select("doc_id", "text", "band", "copy").mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _pairs(ids: list, texts: list[str], copy: list[int], samples: int) -> Iterator[pa.RecordBatch]:
    """Rows of all but the last, except copies."""
    own = [i for i in range(len(ids) - 1) if not copy[i]]
    if not own:
        return
    changed = [edited(texts[i], texts[i + 1]) for i in own]
    signs = signatures(pa.array([*texts, *changed], pa.large_string()), samples)  # together: they share most words
    here, after, other = signs[own], signs[[i + 1 for i in own]], signs[len(texts) :]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([ids[i] for i in own], pa.int64()),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(hex_rows(here)),
            pa.array(hex_rows(other)),
            pa.array(likeness(here, other)),
            pa.array(likeness(here, after)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(hex_rows(signatures(piece.column("text"), samples)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), "doc_id long, fingerprint string")
