"""Quality selection by importance resampling of hashed n-grams.

Two generative models give each document a log importance weight, the sum over its grams of
log(p_target / p_raw).  The raw model counts the grams of all documents, the target model those of
labelled documents that are good (quality 1) and not toxic, in the folds that ``FITS`` names.
Grams are hashed into a fixed number of buckets: runs of letters or of marks and their bigrams
(lower-cased), and, apart from these, word shapes (case, digits, marks, length, repetition) and their
bigrams.

A sum over grams that aren't independent is far too sure of itself, so the weight is tempered: it
is divided by the grams (and ``SHORT`` more, which draws short texts to the middle) and by a
temperature, under which the calibration fold's labels (fold ``CALIBRATES``) lie ``GAP`` units apart
(all documents' standard deviation takes the place of a smaller distance).
Each tempered weight gets Gumbel noise, whose unit is the same, drawn from a hash of the document and
the seed, and the k documents of greatest noisy weight are the sample: a draw of k without
replacement in proportion to the tempered ratios.  Noise decides among near-equals, so another seed
gives another sample; what lies many units below the others hardly ever gets in.

k may be given.  By default it is the number of documents whose tempered weight without noise is no
more than ``MARGIN`` units below that which all but ``LOSE`` of the calibration fold's good ones
reach (Gumbel noise below -3 has a probability of 2e-9).  Fold ``HELD_OUT`` has no part in any of
this, so its labels measure the result.

Cases: a null or empty text has weight 0; equal rows have equal keys and are kept or dropped
together (so ties may exceed k); no good or no bad labels in the folds used keep everything; a null
doc_id has no label; a very long text is a slice by itself; no rows give none; extra columns pass
through ``select_documents`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import cluster, exchange
from tesselon.llm.wordbytes import _SPACE, coded, edges, flat, lowered, mix64, range_hashes, slices

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 12
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
BLOCK = 1 << 10
SMOOTHING = 0.5
#: Text a task holds as grams at a time.
SLICE = 1 << 20
#: Folds (crc32 of the id as text, mod 5): the target model's, the one that sets temperature and k, and the untouched one.
FOLDS, FITS, CALIBRATES, HELD_OUT = 5, (0, 3, 4), 2, 1
SHORT = 16
#: Units between the good labels' quantile ``LOSE`` and the bad labels' quantile 1 - ``BAD``, and k's distance below the former.
GAP, MARGIN, LOSE, BAD = 8.0, 3.0, 0.005, 0.05

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_CLOSING = np.zeros(256, np.int64)
_CLOSING[list(b".,;:")] = 1
_CLOSING[list(b"!?")] = 2
_CLOSING[[b for b in range(33, 127) if not _ALNUM[b] and not _CLOSING[b]]] = 3


def _counts(member: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(member)])
    return sums[end] - sums[start]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every gram."""
    buf, offsets = flat(texts)
    alnum = _ALNUM[buf]
    marks = ~alnum & ~_SPACE[buf]
    docs, buckets = [], []

    def add(start: np.ndarray, values: np.ndarray, low: int, size: int) -> None:
        doc = np.searchsorted(offsets, start, "right") - 1
        docs.append(doc)
        buckets.append((values % np.uint64(size)).astype(np.int64) + low)
        same = doc[1:] == doc[:-1]
        pairs = mix64(values[:-1] * np.uint64(0x9E3779B97F4A7C15) + values[1:])
        docs.append(doc[1:][same])
        buckets.append((pairs[same] % np.uint64(size)).astype(np.int64) + low)

    parts = [edges(m, offsets) for m in (alnum, marks)]
    start, end = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    small = lowered(buf)
    add(start, range_hashes(small, start, end), 0, WORD_BUCKETS)

    start, end = edges(~_SPACE[buf], offsets)
    same = np.zeros(len(start), bool)
    codes = coded(small, start, end)[0]
    same[1:] = codes[1:] == codes[:-1]
    if len(start):
        same[np.searchsorted(start, offsets[:-1]).clip(max=len(start) - 1)] = False  # a text's first word repeats none
    size = end - start
    upper, digits, inside = _counts(_UPPER[buf], start, end), _counts(_DIGIT[buf], start, end), _counts(marks, start, end)
    first_upper = _UPPER[buf[start]] if len(start) else np.zeros(0, bool)
    shape = np.searchsorted([3, 6, 10, 15, 25], size, "right")
    for part, ways in ((np.where(upper > 1, 2, first_upper.astype(np.int64)), 3), (digits > 0, 2), (_CLOSING[buf[end - 1]] if len(end) else np.zeros(0, np.int64), 4), (np.minimum(inside, 3), 4), (same, 2)):
        shape = shape * ways + part
    add(start, mix64(shape.astype(np.uint64) + np.uint64(99)), WORD_BUCKETS, SHAPE_BUCKETS)
    return np.concatenate(docs), np.concatenate(buckets)


def _labelled(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """k1, k2, text and good: 1, 0 (of low quality), or null (no label, or good but toxic)."""
    keyed = exchange.with_keys(docs)
    if labels is None:
        return keyed.withColumn("good", F.lit(None).cast("int"))
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("k1"))
    marks = marks.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    marks = marks.select("k1", F.when(F.col("quality") != 1, 0).when(F.col("toxic") == 0, 1).alias("good"))
    return cluster.sized_join(keyed, cluster.stored(marks, "labels"), "k1", "left", 24).select("k1", "k2", "text", "good")


def _fold():
    return (F.crc32(F.col("k1").cast("string").cast("binary")) % FOLDS).cast("int")


def ratios(rows: DataFrame) -> np.ndarray | None:
    """log(p_target / p_raw) of every bucket; None without good documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                doc, bucket = grams(piece.column("text"))
                good = piece.column("target").to_numpy(zero_copy_only=False)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[doc]], minlength=BUCKETS)
        n = BUCKETS // BLOCK
        blobs = [[a[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(n)] for a in (raw, target)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names=["block", "raw", "target"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.stack([np.frombuffer(raw, np.int64), np.frombuffer(target, np.int64)])
                sums[block] = sums[block] + own if block in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), *(pa.array([s[i].tobytes() for s in sums.values()], pa.binary()) for i in (0, 1))], names=["block", "raw", "target"])

    schema = "block int, raw binary, target binary"
    counted = rows.select("text", (F.coalesce(F.col("good") == 1, F.lit(False)) & _fold().isin(*FITS)).alias("target")).mapInArrow(cluster.tidy(count), schema)
    blocks = BUCKETS // BLOCK
    found = counted.repartition(blocks, "block").mapInArrow(cluster.tidy(add), schema).collect()  # BUCKETS numbers twice, whatever the input
    both = np.zeros((2, BUCKETS))
    for r in found:
        both[:, r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["raw"], np.int64), np.frombuffer(r["target"], np.int64)
    if not both[1].any():
        return None
    out = np.empty(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        p = (both[:, part] + SMOOTHING) / (both[:, part].sum(1, keepdims=True) + SMOOTHING * (part.stop - part.start))
        out[part] = np.log(p[1] / p[0])
    return out


def gumbel(k1: np.ndarray, k2: np.ndarray, seed: int = 0) -> np.ndarray:
    u = (mix64(mix64(k1.view(np.uint64) + np.uint64(seed)) ^ k2.view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5
    return -np.log(-np.log(u / (1 << 53)))


def weighed(docs: DataFrame, labels: DataFrame | None, seed: int = 0) -> DataFrame:
    """A stored table of k1, k2, good, fold, n_grams, log_weight, mean (per gram) and noise."""
    rows = _labelled(docs, labels)
    table = ratios(rows)
    table = np.zeros(BUCKETS) if table is None else table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                doc, bucket = grams(piece.column("text"))
                n = np.bincount(doc, minlength=piece.num_rows)
                weight = np.bincount(doc, table[bucket], piece.num_rows)
                k1, k2 = (piece.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2"))
                columns = [*(piece.column(c) for c in ("k1", "k2", "good", "fold")), *(pa.array(c) for c in (n, weight, weight / (n + SHORT), gumbel(k1, k2, seed)))]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "good", "fold", "n_grams", "log_weight", "mean", "noise"])

    out = rows.withColumn("fold", _fold()).select("k1", "k2", "good", "fold", "text")
    return cluster.stored(out.mapInArrow(cluster.tidy(run), "k1 long, k2 long, good int, fold int, n_grams long, log_weight double, mean double, noise double"), "weights")


def calibration(weights: DataFrame) -> tuple[float, float]:
    """(temperature, least tempered weight that k counts), by the calibration fold or, if a class is missing there, all folds but the held-out one."""
    for folds in ((CALIBRATES,), (*FITS, CALIBRATES)):
        rows = weights.filter(F.col("fold").isin(*folds))
        quantile = lambda good, p: F.percentile_approx(F.when(F.col("good") == good, F.col("mean")), p, 100_000)
        good, bad = rows.agg(quantile(1, LOSE), quantile(0, 1 - BAD)).first()
        if good is not None and bad is not None:
            spread = weights.agg(F.stddev_pop("mean")).first()[0]  # classes that overlap don't make the weights surer
            temperature = max(good - bad, spread, 1e-6) / GAP
            return temperature, good / temperature - MARGIN
    return 1.0, -math.inf


def top_k(weights: DataFrame, k: int) -> DataFrame:
    """Rows whose key is among the k greatest (rows that tie with the last are all kept), without a global sort.

    A histogram of the keys is narrowed to the bin that holds the k-th until its bounds meet.
    """
    low, high, above = -math.inf, math.inf, 0
    n, least, most = weights.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if k >= n:
        return weights
    if k <= 0:
        return weights.limit(0)
    low, high = least, most
    while low < high:
        width = (high - low) / 1000
        if low + width <= low:
            break
        inside = weights.filter((F.col("key") >= low) & (F.col("key") <= high))
        bins = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(999)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b][0] >= k:
                low, high = bins[b][1], bins[b][2]
                break
            above += bins[b][0]
    return weights.filter(F.col("key") >= low)


def sample(docs: DataFrame, labels: DataFrame | None, k: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(kept, all) weights with ``tempered`` and ``key``; ``k`` documents, or as many as the labels suggest."""
    weights = weighed(docs, labels, seed)
    temperature, least = calibration(weights)
    weights = weights.withColumn("tempered", F.col("mean") / temperature).withColumn("key", F.col("tempered") + F.col("noise"))
    if k is None:
        k = weights.filter(F.col("tempered") >= least).count()
    return top_k(weights, k), weights


def selected(docs: DataFrame, labels: DataFrame | None, k: int | None = None, seed: int = 0) -> DataFrame:
    """The sample: doc_id, n_grams, log_weight, tempered and key of each kept row."""
    kept, _ = sample(docs, labels, k, seed)
    return kept.select(F.when(F.col("k1") != -(1 << 63), F.col("k1")).alias("doc_id"), "n_grams", "log_weight", "tempered", "key")


def select_documents(docs: DataFrame, labels: DataFrame | None, k: int | None = None) -> DataFrame:
    """The kept rows of ``docs`` with their columns."""
    kept, weights = sample(docs, labels, k)
    least = kept.agg(F.min("key")).first()[0]
    gone = weights.filter(F.col("key") < least) if least is not None else weights
    a, b = cluster.fresh(docs, "_k1", "_k2")
    gone = cluster.stored(gone.select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "rejected")
    return cluster.sized_join(exchange.named(docs, a, b), gone, [a, b], "left_anti", 40).drop(a, b)
