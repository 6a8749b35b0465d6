"""Random forests and boosted trees of small tables, whole models a task.

A cross-validated search fits hundreds of forests on a table of some thousand rows.  One distributed
fit each would spend its time on jobs, so here the (binned) table goes to every task and each task
grows whole trees from histograms over bins.  Forests that differ in depth, least leaf or weights are
grown together in Java (``Trees.java``); ``grow`` does the same one by one in numpy, for sessions that can't
compile it, all trees of a forest at once, level by level.
Tables beyond ``SMALL_BYTES`` are left to MLlib's distributed fits (``models.grouped_cv``).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.operators import compiled

#: Binned bytes of a table that may go to every task.
SMALL_BYTES = 32 << 20
BINS = 32
#: Drawn rows that a task grows trees of at once (about 100 bytes each); a forest of more is grown in parts.
ROWS_AT_ONCE = 1 << 17
#: Nodes whose histograms a task holds at once.
NODES_AT_ONCE = 1 << 14
#: Tasks of a search; more forests share some.
JOBS_AT_MOST = 2000
#: Forests that are grown together.
TOGETHER = 16
#: Golden ratio and another odd number: steps between hashed values, and branches of a node.
_STEP, _RIGHT, _DRAWS = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F
#: What a drawn positive counts where a negative counts 1, in sums that hold both numbers exactly.
_POSITIVE = 1 << 26


def binned(x: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers of each feature by its quantiles, and the bins' edges."""
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1).astype(np.uint8), edges


class Forest:
    """Trees as arrays: feature (-1: leaf), the last bin that goes left, first child, share of positives."""

    def __init__(self, feature, cut, child, value, trees: int, gains: np.ndarray):
        self.feature, self.cut, self.child, self.value, self.trees, self.gains = feature, cut, child, value, trees, gains
        self.roots = np.arange(trees)

    def probability(self, bins: np.ndarray) -> np.ndarray:
        """Mean over trees of the leaf's share."""
        return self.leaves(bins).mean(0)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Values of the leaves that rows fall into, trees by rows."""
        return next(self.cut_short(bins, [None]))

    def cut_short(self, bins: np.ndarray, depths: Sequence[int | None]) -> Iterator[np.ndarray]:
        """``leaves`` of the trees cut at each of the depths, which ascend (None, unlimited, comes last)."""
        rows = np.arange(len(bins))[None, :]
        at, depth, more = np.repeat(self.roots[:, None], len(bins), 1), 0, True
        for limit in depths:
            while more and (limit is None or depth < limit):
                feature = self.feature[at]
                inner = feature >= 0
                more = inner.any()
                if more:
                    right = bins[rows, np.maximum(feature, 0)] > self.cut[at]
                    at = np.where(inner, self.child[at] + right, at)
                    depth += 1
            yield self.value[at]


def grown(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, trees: int, max_depth: int | None, min_leaf: int, seed: int) -> Iterator[Forest]:
    """A forest of all ``trees`` in parts, each of as many as ``ROWS_AT_ONCE`` allows (one at least); draws are hashes, as in Java."""
    each = max(1, min(trees, ROWS_AT_ONCE // max(len(bins), 1)))
    for first in range(0, trees, each):
        some = min(each, trees - first)
        drawn = np.stack([_bootstrap(k, len(bins)) for k in tree_keys(seed, first, some)])
        yield grow(bins, label, weight, some, max_depth, min_leaf, seed, first, drawn)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_keys(seed: int, first: int, trees: int) -> np.ndarray:
    """What a forest's trees ``first`` and on draw by."""
    return _mixed(_mixed(np.full(trees, seed).astype(np.uint64)) + np.arange(first + 1, first + trees + 1, dtype=np.uint64))


def _below(x: np.ndarray, n: int) -> np.ndarray:
    """A hash as a number below n."""
    return ((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _bootstrap(key: np.uint64, n: int) -> np.ndarray:
    """How often each of n rows is drawn."""
    base = _mixed(np.array([key ^ np.uint64(_DRAWS)]))
    return np.bincount(_below(_mixed(base + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP)), n).astype(np.int64), minlength=n)


def _choices(keys: np.ndarray, width: int, tried: int) -> np.ndarray:
    """Features that nodes try: the first of a shuffle."""
    out, node = np.tile(np.arange(width), (len(keys), 1)), np.arange(len(keys))
    for k in range(tried):
        at = k + _below(_mixed(keys + np.uint64((k + 1) * _STEP % 2**64)), width - k).astype(np.int64)
        out[node, at], out[:, k] = out[:, k].copy(), out[node, at]
    return out[:, :tried]


def voted(parts: Iterator[Forest], test: np.ndarray, depths: Sequence[int | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean probability of the test rows over all trees of the parts, and the mean importances; one part is held at a time.

    With depths (as of ``cut_short``): the probabilities of the forest cut at each, a row a depth.
    """
    said, gains, trees = 0.0, 0.0, 0
    for forest in parts:
        step = max(1, ROWS_AT_ONCE // forest.trees)
        pieces = [test[a : a + step] for a in range(0, len(test), step)]
        if depths is None:
            own = [forest.probability(x) for x in pieces] + [np.zeros(0)]
        else:
            own = [np.stack([v.mean(0) for v in forest.cut_short(x, depths)]) for x in pieces] + [np.zeros((len(depths), 0))]
        said, gains, trees = said + np.concatenate(own, -1) * forest.trees, gains + forest.gains * forest.trees, trees + forest.trees
    return said / trees, gains / trees


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, trees: int, max_depth: int | None, min_leaf: int, seed: int, first: int = 0, drawn: np.ndarray | None = None) -> Forest:
    """Bootstrapped trees that split by weighted Gini impurity on sqrt(features) random features a node.

    They are trees ``first`` and on of the forest of the seed; ``drawn`` tells how often each tree draws each row (else numpy draws).

    ``weight`` must be that of the row's label, so counts of both labels tell all.  ``min_leaf`` counts drawn rows; a
    node becomes a leaf when it is pure, at the greatest depth, or without a gain.  Trees of less depth from the same seed
    are the same ones cut short.
    """
    n, width = bins.shape
    tried = max(1, int(np.sqrt(width)))
    is_positive = label == 1
    heavy = [float(weight[x][0]) if x.any() else 1.0 for x in (~is_positive, is_positive)]
    if (weight != np.where(is_positive, heavy[1], heavy[0])).any():
        raise ValueError("weights must depend on the label only")
    flat = np.ascontiguousarray(bins).ravel()
    if drawn is None:
        drawn = np.random.default_rng([seed, first]).multinomial(n, np.full(n, 1 / n), trees)
    tree, row = np.nonzero(drawn)
    drawn = drawn[tree, row]
    count = np.where(is_positive[row], drawn * float(_POSITIVE), drawn)  # numbers of both labels in one
    node = tree.copy()  # of each drawn row, numbered within the level
    m, base, depth = trees, 0, 0
    features, cuts, children, values, gains = [], [], [], [], np.zeros((trees, width))
    of_tree, keys = np.arange(trees), tree_keys(seed, first, trees)
    while m:
        both = np.bincount(node, count, m)
        neg, pos = _parted(both)
        w, p = neg * heavy[0] + pos * heavy[1], pos * heavy[1]
        feature, cut = np.full(m, -1), np.zeros(m, np.int64)
        best = np.full(m, 1e-12)
        grown = (pos > 0) & (neg > 0) & (neg + pos >= 2 * min_leaf)
        if max_depth is not None and depth >= max_depth:
            grown[:] = False
        live = np.flatnonzero(grown)
        if len(live):
            place = np.full(m, -1)
            place[live] = np.arange(len(live))
            held = np.flatnonzero(place[node] >= 0)
            if len(live) > NODES_AT_ONCE:
                held = held[np.argsort(place[node[held]], kind="stable")]
            every = place[node[held]]
            for begin in range(0, len(live), NODES_AT_ONCE):
                some = live[begin : begin + NODES_AT_ONCE]
                own, rows = every, held
                if len(some) < len(live):
                    a, b = np.searchsorted(every, (begin, begin + len(some)))
                    own, rows = every[a:b] - begin, held[a:b]
                choices = _choices(keys[some], width, tried)
                start, number = row[rows] * width, count[rows]
                slot = own * BINS
                for k in range(tried):
                    f = choices[:, k].copy()
                    hist = np.bincount(slot + flat.take(start + f.take(own)), number, len(some) * BINS)
                    value, at = _best_cuts(hist.reshape(-1, BINS), both[some], heavy[1] / heavy[0], max(min_leaf, 1))
                    better = value > best[some]
                    best[some[better]], feature[some[better]], cut[some[better]] = value[better], f[better], at[better]
        split = feature >= 0
        np.add.at(gains, (of_tree[split], feature[split]), best[split])
        number = np.cumsum(split) - 1
        child = np.where(split, base + m + 2 * number, 0)
        features.append(feature)
        cuts.append(cut)
        children.append(child)
        values.append(np.where(w > 0, p / np.where(w > 0, w, 1), 0.0))
        keep = np.flatnonzero(split[node])
        at = node[keep]
        right = flat[row[keep] * width + feature[at]] > cut[at]
        node, row, count = 2 * number[at] + right, row[keep], count[keep]
        of_tree = np.repeat(of_tree[split], 2)
        keys = _mixed(np.stack([keys[split] ^ np.uint64(_STEP), keys[split] ^ np.uint64(_RIGHT)], 1).ravel())
        base, m, depth = base + m, 2 * int(split.sum()), depth + 1
    total = gains.sum(1, keepdims=True)
    return Forest(*(np.concatenate(x) for x in (features, cuts, children, values)), trees, (gains / np.where(total > 0, total, 1)).mean(0))


def _parted(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negatives and positives."""
    pos = np.floor(both * (1 / _POSITIVE))
    return both - pos * _POSITIVE, pos


def _best_cuts(hist: np.ndarray, both: np.ndarray, heavy: float, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest gain of each node and its (first) cut, from a histogram a node; a positive weighs ``heavy``, others 1.

    With n and p negatives and positives and w their weight, the gain is 2 h^2 (p_left n - p n_left)^2 / (w w_left w_right).
    """
    (n, p), ln = (x[:, None] for x in _parted(both)), hist.cumsum(1)[:, :-1]
    lp = ln * (1 / _POSITIVE)
    np.floor(lp, out=lp)
    part = lp * _POSITIVE
    ln -= part
    few = None
    if min_leaf > 1:
        np.add(ln, lp, out=part)
        few = (part < min_leaf) | (part > n + p - min_leaf)
    np.multiply(lp, heavy, out=part)
    part += ln  # weight on the left
    w = n + p * heavy
    lp *= n
    ln *= p
    lp -= ln
    lp *= lp
    np.subtract(w, part, out=ln)
    part *= ln
    lp /= np.maximum(part, 1e-9, out=part)  # an empty side: no gain
    if few is not None:
        lp[few] = -1
    at = lp.argmax(1)
    return lp[np.arange(len(at)), at] * (2 * heavy * heavy) / w[:, 0], at


class Boosted(Forest):
    """Trees whose leaves add up to the logarithm of the odds."""

    def probability(self, bins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.leaves(bins).sum(0)))


def boost(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int, max_depth: int | None, min_child: float, rate: float = 0.3, shrink: float = 1.0) -> Boosted:
    """Trees by Newton steps on the logistic loss: a split's gain and a leaf's value come from sums of gradients and Hessians.

    ``min_child`` is a child's least sum of Hessians, ``shrink`` the penalty on squared leaf values; depth 6 unless given.
    """
    n, width = bins.shape
    max_depth = 6 if max_depth is None else max_depth
    slots = bins.astype(np.int64) + np.arange(width) * BINS
    margin = np.zeros(n)
    nodes: list[list] = [[], [], [], []]  # feature, cut, child, value
    roots, gains, base = [], np.zeros(width), 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - label), weight * p * (1 - p)
        node, row, m, depth = np.zeros(n, np.int64), np.arange(n), 1, 0
        roots.append(base)
        while m:
            own = slots[row] + node[:, None] * (width * BINS)
            lg, lh = (np.bincount(own.ravel(), np.repeat(x[row], width), m * width * BINS).reshape(m, width, BINS) for x in (g, h))
            tg, th = lg[:, 0].sum(1), lh[:, 0].sum(1)
            lg, lh = lg.cumsum(2)[..., :-1], lh.cumsum(2)[..., :-1]
            rg, rh = tg[:, None, None] - lg, th[:, None, None] - lh
            gain = lg * lg / (lh + shrink) + rg * rg / (rh + shrink) - (tg * tg / (th + shrink))[:, None, None]
            gain[(lh < min_child) | (rh < min_child)] = -1
            flat = gain.reshape(m, -1)
            at = flat.argmax(1)
            value = flat[np.arange(m), at]
            split = (value > 1e-9) & (depth < max_depth)
            feature, cut = np.where(split, at // (BINS - 1), -1), at % (BINS - 1)
            np.add.at(gains, feature[split], value[split])
            number = np.cumsum(split) - 1
            leaf = -rate * tg / (th + shrink)
            for out, x in zip(nodes, (feature, cut, np.where(split, base + m + 2 * number, 0), leaf), strict=True):
                out.append(x)
            ended = ~split[node]
            margin[row[ended]] += leaf[node[ended]]
            node, row = node[~ended], row[~ended]
            node = 2 * number[node] + (bins[row, feature[node]] > cut[node])
            base, m, depth = base + m, 2 * int(split.sum()), depth + 1
    trees = Boosted(*(np.concatenate(x) for x in nodes), rounds, gains / (gains.sum() or 1))
    trees.roots = np.array(roots)
    return trees


def is_small(rows: DataFrame, features: Sequence[str]) -> bool:
    return rows.count() * len(features) <= SMALL_BYTES


def cross_validated(rows: DataFrame, features: Sequence[str], settings: DataFrame, fold: str = "fold", importance: bool = False, kind: str = "rf") -> DataFrame:
    """Confusion counts of every setting and fold; ``kind``: rf or gbt.

    ``settings`` has setting, trees, max_depth (null: unlimited), min_leaf, multiplier and seed; ``rows``
    (a small table, see ``is_small``) features, label and fold.  Forests are fitted on all folds but one; settings
    that differ in depth only have one forest, grown to the greatest and cut at each.
    Returns setting, fold, true_pos, true_neg, false_pos, false_neg and, if asked for, importances.
    """
    spark = rows.sparkSession
    table = rows.select(*[F.col(f).cast("double") for f in features], F.col("label").cast("int").alias("label"), F.col(fold).alias("fold")).toPandas()  # small: checked by the caller
    bins, _ = binned(table[list(features)].to_numpy())
    label, folds = table["label"].to_numpy(np.float64), table["fold"].to_numpy()
    if kind == "rf":
        try:
            function = compiled.function(spark, "Trees", "binary")
        except (Py4JError, PySparkException, AttributeError, OSError) as why:
            warnings.warn(f"forests are grown by numpy, as Java's can't be compiled or sent here: {why}", stacklevel=2)
        else:
            return _together(spark, function, bins, label, folds, settings, importance)
    sent = spark.sparkContext.broadcast((bins, label, folds))
    alike: dict[tuple, list[tuple[float, int]]] = {}
    for r in settings.collect():  # one row a setting
        own = r["setting"] if importance or kind != "rf" else None
        alike.setdefault((own, r["trees"], r["min_leaf"], r["multiplier"], r["seed"]), []).append((float("inf") if r["max_depth"] is None else float(r["max_depth"]), r["setting"]))
    names = [int(f) for f in np.unique(folds)]
    jobs = [(f, *key[1:], *([*x] for x in zip(*sorted(of), strict=True))) for key, of in alike.items() for f in names]
    jobs.sort(key=lambda j: (-j[5][-1], j[2]))  # the deepest first
    schema = "fold long, trees int, min_leaf int, multiplier double, seed int, depths array<double>, settings array<long>"
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(jobs, max(1, min(len(jobs), JOBS_AT_MOST))), schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, label, folds = sent.value
        for batch in batches:
            out = []
            for job in batch.to_dict("records"):
                test = folds == job["fold"]
                y = label[~test]
                weight = np.where(y == 1, (y == 0).sum() / max((y == 1).sum(), 1) * job["multiplier"], 1.0)
                depths = [None if np.isinf(d) else int(d) for d in job["depths"]]
                if kind == "rf":
                    parts = grown(bins[~test], y, weight, int(job["trees"]), depths[-1], int(job["min_leaf"]), int(job["seed"]))
                    probabilities, gains = voted(parts, bins[test], depths)
                else:
                    parts = iter([boost(bins[~test], y, weight, int(job["trees"]), depths[-1], float(job["min_leaf"]))])
                    probability, gains = voted(parts, bins[test])
                    probabilities = [probability]
                for setting, probability in zip(job["settings"], probabilities, strict=True):
                    said, true = probability > 0.5, label[test] == 1
                    counts = [int(x.sum()) for x in (said & true, ~said & ~true, said & ~true, ~said & true)]
                    out.append((setting, job["fold"], *counts, gains.tolist() if importance else None))
            yield pd.DataFrame(out, columns=["setting", "fold", "true_pos", "true_neg", "false_pos", "false_neg", "gains"])

    return jobs.mapInPandas(run, "setting long, fold long, true_pos long, true_neg long, false_pos long, false_neg long, gains array<double>")


def packed(bins: np.ndarray, label: np.ndarray, place: np.ndarray) -> bytearray:
    """A table as Java reads it: numbers of rows and features, each row's fold, label (neither 1 nor 0: 2) and bins."""
    labels = np.where(label == 1, 1, np.where(label == 0, 0, 2)).astype(np.uint8)
    return bytearray(np.array(bins.shape, "<i4").tobytes() + place.astype("<i4").tobytes() + labels.tobytes() + np.ascontiguousarray(bins).tobytes())


def _together(spark, function: str, bins: np.ndarray, label: np.ndarray, folds: np.ndarray, settings: DataFrame, importance: bool) -> DataFrame:
    """``cross_validated`` in Java: forests of one seed are grown together, and the trees of a fold are dealt over as many tasks as it has forests."""
    names, place = np.unique(folds, return_inverse=True)
    alike: dict[tuple, dict[tuple, list[tuple[float, int]]]] = {}
    for r in settings.collect():  # one row a setting
        group = alike.setdefault((r["setting"] if importance else None, r["trees"], r["seed"]), {})
        group.setdefault((r["min_leaf"], r["multiplier"]), []).append((float("inf") if r["max_depth"] is None else float(r["max_depth"]), r["setting"]))
    groups = []  # trees, seed, forests: (least leaf, multiplier), depths and settings
    for (_, trees, seed), of in alike.items():
        forests = [(key, sorted(at)) for key, at in sorted(of.items())]
        groups += [(trees, seed, forests[a : a + TOGETHER]) for a in range(0, len(forests), TOGETHER)]
    jobs = []
    for g, (trees, seed, forests) in enumerate(groups):
        shares = max(1, min(len(forests), trees))
        said = [x for (leaf, multiplier), at in forests for x in (leaf, multiplier, len(at), *(d for d, _ in at))]
        for f in range(len(names)):
            for s in range(shares):
                first, end = trees * s // shares, trees * (s + 1) // shares
                jobs.append((g, f, s, bytearray(np.array([f, seed, first, end - first, len(forests), *said], "<f8").tobytes())))
    tasks = max(1, min(len(jobs), JOBS_AT_MOST))
    table = spark.createDataFrame(spark.sparkContext.parallelize([(packed(bins, label, place),)], 1), "rows binary")  # small: checked by the caller
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(jobs, tasks), "forests int, place int, share int, job binary")
    votes = jobs.crossJoin(F.broadcast(table)).select("forests", "place", "share", F.call_function(function, "rows", "job").alias("votes"))
    sent, width = spark.sparkContext.broadcast((label == 1, place)), bins.shape[1]

    def counted(votes: pd.DataFrame) -> pd.DataFrame:
        g, f = int(votes["forests"].iloc[0]), int(votes["place"].iloc[0])
        trees, _, forests = groups[g]
        positive, place = sent.value
        true, total = positive[place == f], 0.0
        for share in votes.sort_values("share")["votes"]:
            total = total + np.frombuffer(share, "<f8")
        mean, out, line = total / trees, [], 0
        gains = mean[len(mean) - width * len(forests) :].reshape(-1, width)
        for forest, (_, at) in enumerate(forests):
            for _, setting in at:
                said = mean[line : line + len(true)] > 0.5
                line += len(true)
                counts = [int(x.sum()) for x in (said & true, ~said & ~true, said & ~true, ~said & true)]
                out.append((setting, int(names[f]), *counts, gains[forest].tolist() if importance else None))
        return pd.DataFrame(out, columns=["setting", "fold", "true_pos", "true_neg", "false_pos", "false_neg", "gains"])

    schema = "setting long, fold long, true_pos long, true_neg long, false_pos long, false_neg long, gains array<double>"
    return votes.repartition(tasks, "forests", "place").groupBy("forests", "place").applyInPandas(counted, schema)
