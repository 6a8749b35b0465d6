"""Perceptrons with one hidden layer on small tables, a whole fit a task.

MLlib runs at least one job an iteration and fold, 200 iterations and 10 folds at that; where the table is
small, here it goes to every task instead and each task fits one fold's network.  The model is that of
MLlib's ``MultilayerPerceptronClassifier``: sigmoids, softmax over two classes, mean cross-entropy, first
weights uniform within 2.4 / sqrt(inputs), L-BFGS of 10 corrections with strong Wolfe steps, and an end when the
loss lies within a millionth of itself from its mean over ten iterations, or the gradient is as small.  Tables beyond ``SMALL_BYTES`` are left to MLlib (``models.mlp_cv``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of features (as doubles) that may go to every task.
SMALL_BYTES = 64 << 20
#: Rows whose activations are held at once.
ROWS_AT_ONCE = 4096
CORRECTIONS, TOLERANCE, HISTORY = 10, 1e-6, 10
#: Sufficient decrease and curvature of a step, and steps tried in one search.
DECREASE, CURVATURE, STEPS = 1e-4, 0.9, 20


def first_weights(inputs: int, hidden: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, n_out * (n_in + 1)) / np.sqrt(n_in) for n_in, n_out in ((inputs, hidden), (hidden, 2))])


def _layers(weights: np.ndarray, inputs: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views of the weights: hidden layer, its biases, output layer, its biases."""
    a, b, c = inputs * hidden, (inputs + 1) * hidden, (inputs + 3) * hidden
    return weights[:a].reshape(inputs, hidden), weights[a:b], weights[b:c].reshape(hidden, 2), weights[c:]


def _forward(weights: np.ndarray, x: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Hidden activations, and the logarithm of the odds of a positive."""
    w1, b1, w2, b2 = _layers(weights, x.shape[1], hidden)
    with np.errstate(over="ignore"):
        act = 1 / (1 + np.exp(-(x @ w1 + b1)))
    return act, act @ (w2[:, 1] - w2[:, 0]) + (b2[1] - b2[0])


def loss(weights: np.ndarray, x: np.ndarray, label: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of all rows, and its gradient."""
    total, gradient = 0.0, np.zeros_like(weights)
    g1, gb1, g2, gb2 = _layers(gradient, x.shape[1], hidden)
    w2 = _layers(weights, x.shape[1], hidden)[2]
    for a in range(0, len(x), ROWS_AT_ONCE):
        own, y = x[a : a + ROWS_AT_ONCE], label[a : a + ROWS_AT_ONCE]
        act, odds = _forward(weights, own, hidden)
        total += (np.logaddexp(0, odds) - y * odds).sum()
        with np.errstate(over="ignore"):
            error = 1 / (1 + np.exp(-odds)) - y
        back = error[:, None] * (w2[:, 1] - w2[:, 0]) * act * (1 - act)
        g1 += own.T @ back
        gb1 += back.sum(0)
        g2[:, 1] += act.T @ error
        gb2[1] += error.sum()
    g2[:, 0], gb2[0] = -g2[:, 1], -gb2[1]
    return total / len(x), gradient / len(x)


def _step(f: Callable, at: np.ndarray, value: float, slope: float, along: np.ndarray, first: float) -> tuple[float, np.ndarray] | None:
    """Value and gradient where both Wolfe conditions hold, found by doubling, then by parabolas and halving; else at the least value seen below the first."""
    low, high, of_low, slope_low = 0.0, np.inf, value, slope
    size, best = first, None
    for _ in range(STEPS):
        now, gradient = f(at + size * along)
        rate = gradient @ along
        if np.isfinite(now) and now < value and (best is None or now < best[1]):
            best = (size, now, gradient)
        if not np.isfinite(now) or now > value + DECREASE * size * slope or (low > 0 and now >= of_low):
            high = size
            bend = now - of_low - slope_low * (size - low)
            quadratic = low - slope_low * (size - low) ** 2 / (2 * bend) if np.isfinite(bend) and bend > 0 else low
            size = min(max(quadratic, low + 0.1 * (high - low)), low + 0.9 * (high - low))
        elif abs(rate) <= -CURVATURE * slope:
            return size, now, gradient
        elif rate > 0:
            high, size = size, low + (size - low) * slope_low / (slope_low - rate)
        else:
            low, of_low, slope_low = size, now, rate
            size = 2 * size if high == np.inf else (low + high) / 2
    return best


def fit(x: np.ndarray, label: np.ndarray, hidden: int, iterations: int, seed: int) -> np.ndarray:
    """Weights after at most so many iterations of L-BFGS."""
    if not len(x):
        raise ValueError("no rows to learn from")
    f = lambda w: loss(w, x, label, hidden)
    weights = first_weights(x.shape[1], hidden, seed)
    value, gradient = f(weights)
    kept: list[tuple[np.ndarray, np.ndarray, float]] = []
    values = [value]
    for _ in range(iterations):
        along = -gradient
        turns = []
        for s, y, r in reversed(kept):
            turns.append(r * (s @ along))
            along = along - turns[-1] * y
        if kept:
            s, y, r = kept[-1]
            along = along / (r * (y @ y))
        for (s, y, r), turn in zip(kept, reversed(turns), strict=True):
            along = along + (turn - r * (y @ along)) * s
        slope = gradient @ along
        if slope >= 0:
            kept, along = [], -gradient
            slope = gradient @ along
        found = _step(f, weights, value, slope, along, 1.0 if kept else 1 / max(np.sqrt(-slope), 1e-300)) if slope else None
        if found is None:
            if not kept:
                break  # no way down
            kept = []
            continue
        size, new, after = found
        moved, turned = size * along, after - gradient
        if moved @ turned > 0:
            kept = [*kept[1 - CORRECTIONS :], (moved, turned, 1 / (moved @ turned))]
        weights, gradient, value = weights + moved, after, new
        values = [*values, value][-HISTORY:]
        if len(values) == HISTORY and np.mean(values) - value <= TOLERANCE * value or np.linalg.norm(gradient) <= max(TOLERANCE * value, 1e-8):
            break
    return weights


def probability(weights: np.ndarray, x: np.ndarray, hidden: int) -> np.ndarray:
    """Probability of a positive."""
    odds = [_forward(weights, x[a : a + ROWS_AT_ONCE], hidden)[1] for a in range(0, len(x), ROWS_AT_ONCE)]
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-np.concatenate([*odds, np.zeros(0)])))


def is_small(rows: DataFrame, features: Sequence[str]) -> bool:
    return rows.count() * len(features) * 8 <= SMALL_BYTES


def cross_validated(rows: DataFrame, features: Sequence[str], hidden: int, iterations: int, fold: str = "fold", seed: int = 42) -> DataFrame:
    """fold, true_pos, true_neg, false_pos and false_neg of the network of all other folds; a small table, without nulls and NaN."""
    spark = rows.sparkSession
    table = rows.select(*[F.col(f).cast("double") for f in features], F.col("label").cast("double").alias("label"), F.col(fold).alias("fold")).toPandas()  # small: checked by the caller
    if table.isna().any(axis=None):
        raise ValueError("features, label and fold must not be null or NaN")
    x, label, folds = np.ascontiguousarray(table[list(features)].to_numpy()), table["label"].to_numpy(), table["fold"].to_numpy()
    del table
    names = sorted({int(f) for f in folds})
    sent = spark.sparkContext.broadcast((x, label, folds))
    jobs = spark.createDataFrame(spark.sparkContext.parallelize([(f,) for f in names], max(len(names), 1)), "fold long")  # one fit a task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, label, folds = sent.value
        for batch in batches:
            for f in batch["fold"].tolist():
                test = folds == f
                said = probability(fit(x[~test], label[~test], hidden, iterations, seed), x[test], hidden) > 0.5
                true = label[test] == 1
                yield pd.DataFrame([(f, *(int(n.sum()) for n in (said & true, ~said & ~true, said & ~true, ~said & true)))], columns=["fold", "true_pos", "true_neg", "false_pos", "false_neg"])

    return jobs.mapInPandas(run, "fold long, true_pos long, true_neg long, false_pos long, false_neg long")
