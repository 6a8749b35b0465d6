"""Whole forests a task: trees against a plain search for the best split, limits, and folds by location."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import forest, models, sampling


def plain_split(bins, label, weight, min_leaf):
    """(gain, feature, cut) of the best split of all rows, one by one."""

    def impurity(w, y):
        return 2 * (w * y).sum() * (w * (1 - y)).sum() / w.sum() if w.sum() else 0.0

    best = (0.0, -1, 0)
    for f in range(bins.shape[1]):
        for cut in range(int(bins[:, f].max())):
            left = bins[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= min_leaf:
                gain = impurity(weight, label) - impurity(weight[left], label[left]) - impurity(weight[~left], label[~left])
                best = max(best, (gain, f, cut), key=lambda b: b[0] - 1e-9 * b[1])
    return best


def test_root_splits_are_the_best(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(forest.np, "sqrt", lambda x: x)  # every feature is tried
    for _ in range(10):
        bins = rng.integers(0, 8, (60, 5)).astype(np.uint8)
        label = (bins[:, 2] + rng.integers(0, 4, 60) > 5).astype(float)
        weight = np.where(label == 1, 2.0, 1.0)

        class Rows:  # every row is drawn once
            def __init__(self, seed):
                self.rng = np.random.Generator(np.random.PCG64(seed))

            def multinomial(self, n, p, trees):
                return np.ones((trees, n), int)

            def random(self, shape):
                return self.rng.random(shape)

        monkeypatch.setattr(forest.np.random, "default_rng", Rows)
        grown = forest.grow(bins, label, weight, 1, 1, 5, 1)
        monkeypatch.undo()
        monkeypatch.setattr(forest.np, "sqrt", lambda x: x)
        gain, feature, cut = plain_split(bins, label, weight, 5)
        assert grown.feature[0] == feature and grown.cut[0] == cut and grown.gains[feature] == pytest.approx(1.0)
        left = bins[:, feature] <= cut
        shares = [(weight * label)[s].sum() / weight[s].sum() for s in (left, ~left)]
        assert grown.value[1:].tolist() == pytest.approx(shares)
        assert grown.probability(bins).tolist() == pytest.approx(np.where(left, *shares).tolist())


def test_limits_and_learning():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 9))
    y = (x[:, 4] > 0).astype(float)
    bins, edges = forest.binned(x)
    assert bins.max() < forest.BINS and len(edges) == 9
    grown = forest.grow(bins[:400], y[:400], np.ones(400), 30, None, 1, 7)
    assert ((grown.probability(bins[400:]) > 0.5) == (y[400:] == 1)).mean() > 0.9 and grown.gains.argmax() == 4
    again = forest.grow(bins[:400], y[:400], np.ones(400), 30, None, 1, 7)
    assert (again.probability(bins) == grown.probability(bins)).all()
    assert len(forest.grow(bins, y, np.ones(600), 5, 2, 1, 7).feature) <= 5 * 7
    assert len(forest.grow(bins, np.ones(600), np.ones(600), 5, None, 1, 7).feature) == 5  # pure: no splits
    assert len(forest.grow(bins, y, np.ones(600), 3, None, 400, 7).feature) == 3  # leaves too large to split


def test_boosting_takes_newton_steps():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 6, (80, 3)).astype(np.uint8)
    label, weight = (bins[:, 1] > 2).astype(float), np.where(bins[:, 0] > 2, 2.0, 1.0)
    one = forest.boost(bins, label, weight, 1, 1, 0.0)
    assert (one.feature[0], one.cut[0]) == (1, 2)
    g, h, left = weight * (0.5 - label), weight * 0.25, bins[:, 1] <= 2
    assert one.value[1:3].tolist() == pytest.approx([-0.3 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])
    noisy = np.where(rng.random(80) < 0.1, 1 - label, label)
    many = forest.boost(bins, noisy, np.ones(80), 40, 3, 1.0)
    loss = [-(np.log(np.where(noisy == 1, q, 1 - q))).mean() for q in (forest.boost(bins, noisy, np.ones(80), n, 3, 1.0).probability(bins) for n in (1, 10, 40))]
    assert loss[0] > loss[1] > loss[2] and many.gains.argmax() == 1 and len(many.roots) == 40


def test_forest_runs_match_single_forests(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    rows = spark.createDataFrame([(*map(float, r), int(r[1] > 0.2), i % 3) for i, r in enumerate(x)], "a double, b double, c double, d double, label int, fold long")
    found = {(r.setting, r.fold): r for r in models.forest_cv(rows, list("abcd"), [{"n": 20}, {"n": 20, "max_depth": 1, "min_leaf": 3}], importance=True).collect()}
    assert len(found) == 6 and all(r.accuracy > 0.7 and r.true_pos + r.true_neg + r.false_pos + r.false_neg == 40 for r in found.values())
    assert models.forest_importances(models.forest_cv(rows, list("abcd"), [{"n": 20}], importance=True), list("abcd")).first().feature == "b"
    grid = models.grid_search(rows, list("abcd"), "rf", {"max_depth": (1, None), "min_leaf": (1, 5)}, (0.5, 1.0), n=10).collect()
    assert len(grid) == 8 and grid[0].pooled_accuracy == max(r.pooled_accuracy for r in grid)
    assert models.seed_stability(rows, list("abcd"), "rf", (1, 2, 3), n=10).first().seeds == 3


def test_location_folds(spark):
    rows = spark.range(200).select("id", (F.col("id") % 20).alias("tile"), ((F.col("id") % 20 < 4) & (F.col("id") % 3 == 0)).cast("int").alias("label"))
    dealt = sampling.location_folds(rows, F.col("tile"), F.col("id").cast("string"))
    assert dealt.columns == ["id", "tile", "label", "fold"] and dealt.count() == 200
    assert {(r.tile, r.fold) for r in dealt.filter("label = 1").collect()} == {(t, t) for t in range(4)}
    sizes = sorted(r["count"] for r in dealt.filter("label = 0").groupBy("fold").count().collect())
    assert len(sizes) == 4 and sizes[-1] - sizes[0] <= 1
    assert {r.fold for r in sampling.location_folds(rows.withColumn("label", F.lit(0)), F.col("tile"), F.col("id").cast("string")).collect()} == {0}


def test_forests_grow_in_parts(monkeypatch):
    """All trees whatever the memory: 300 trees of 100000 rows were drawn at once, over 1 GB a task."""
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 16, (400, 6)).astype(np.uint8)
    label = (bins[:, 1] + rng.integers(0, 10, 400) > 12).astype(float)
    whole = forest.grow(bins, label, np.ones(400), 20, None, 1, 5)
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 7)  # the same trees from fewer histograms at once
    few = forest.grow(bins, label, np.ones(400), 20, None, 1, 5)
    assert np.array_equal(whole.feature, few.feature) and np.array_equal(whole.cut, few.cut) and np.allclose(whole.gains, few.gains)
    monkeypatch.setattr(forest, "ROWS_AT_ONCE", 1300)  # three trees at once
    parts = list(forest.grown(bins, label, np.ones(400), 20, None, 1, 5))
    assert [p.trees for p in parts] == [3] * 6 + [2] and not np.array_equal(parts[0].feature, parts[1].feature)
    said, gains = forest.voted(iter(parts), bins)
    assert np.allclose(said, np.concatenate([p.leaves(bins) for p in parts]).mean(0)) and gains.sum() == pytest.approx(1)
    assert ((said > 0.5) == (label == 1)).mean() > 0.9


def test_forests_that_differ_in_depth_are_grown_once(spark, monkeypatch):
    """The grid grew a forest for each depth, too many for the time given; now as many trees vote, each cut at every depth."""
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 16, (300, 5)).astype(np.uint8)
    label = (bins[:, 1] + rng.integers(0, 10, 300) > 12).astype(float)
    weight = np.where(label == 1, 1.7, 1.0)
    monkeypatch.setattr(forest, "ROWS_AT_ONCE", 1300)  # in parts
    said, _ = forest.voted(forest.grown(bins, label, weight, 10, None, 2, 9), bins, [0, 1, 3, None])
    for depth, own in zip((0, 1, 3, None), said, strict=True):
        assert np.array_equal(own, forest.voted(forest.grown(bins, label, weight, 10, depth, 2, 9), bins)[0])
    monkeypatch.undo()
    rows = spark.createDataFrame([(*map(int, b), int(y), i % 3) for i, (b, y) in enumerate(zip(bins, label, strict=True))], "a int, b int, c int, d int, e int, label int, fold long")
    settings = [{"n": 10, "max_depth": d, "min_leaf": leaf, "multiplier": m} for d in (None, 1, 3) for leaf in (1, 4) for m in (0.5, 1.0)]
    runs = models.forest_cv(rows, list("abcde"), settings)
    found = {(r.setting, r.fold): r.asDict() for r in runs.collect()}
    assert len(found) == 36 and runs.rdd.getNumPartitions() == 12  # 36 forests of 10 trees before
    for i, s in enumerate(settings):
        for r in models.forest_cv(rows, list("abcde"), [s]).collect():
            assert r.asDict() | {"setting": i} == found[i, r.fold]


def test_cuts_are_the_best():
    rng = np.random.default_rng(5)
    for min_leaf in (1, 3):
        count, positive = rng.integers(0, 3, (2, 200, forest.BINS))
        negative = count * (rng.random(count.shape) < 0.2)
        hist = (negative + positive * forest._POSITIVE).astype(float)
        value, at = forest._best_cuts(hist, hist.sum(1), 1.7, min_leaf)
        for i in range(200):
            n, p = negative[i], positive[i] * 1.7
            of = lambda n, p: 2 * n * p / (n + p) if n + p else 0.0
            gains = [of(n.sum(), p.sum()) - of(n[:c].sum(), p[:c].sum()) - of(n[c:].sum(), p[c:].sum()) if min((n + positive[i])[:c].sum(), (n + positive[i])[c:].sum()) >= min_leaf else -1 for c in range(1, forest.BINS)]
            assert value[i] == pytest.approx(max(gains), abs=1e-9) and (value[i] < 1e-9 or gains[at[i]] == pytest.approx(value[i], abs=1e-9))
    with pytest.raises(ValueError, match="label"):
        forest.grow(np.zeros((2, 1), np.uint8), np.zeros(2), np.array([1.0, 2.0]), 1, None, 1, 1)


def test_java_grows_the_same_forests(spark, monkeypatch):
    """Forests of different leaves and weights were grown one by one in numpy, too slowly for 1 GB; together in Java they vote the same."""
    from tesselon.operators import compiled

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 70))
    label = (x[:, 1] + rng.normal(size=400) > 0.4).astype(int)
    rows = spark.createDataFrame([(*map(float, r), int(y), i % 4) for i, (r, y) in enumerate(zip(x, label, strict=True))], ", ".join(f"x{i} double" for i in range(70)) + ", label int, fold long")
    names = [f"x{i}" for i in range(70)]
    settings = [{"n": 7, "max_depth": d, "min_leaf": leaf, "multiplier": m, "seed": s} for s in (1, 2) for d in (0, 3, None) for leaf in (1, 4, 10) for m in (0.5, 1.0, 1.5)]
    together, calls = forest._together, []
    monkeypatch.setattr(forest, "_together", lambda *a: calls.append(1) or together(*a))
    found = sorted(models.forest_cv(rows, names, settings).collect())
    one = sorted(models.forest_cv(rows, names, settings[24:27], importance=True).collect())
    assert calls == [1, 1] and len(found) == 4 * 54

    def refused(*_):
        raise AttributeError("no Java")

    monkeypatch.setattr(compiled, "function", refused)
    with pytest.warns(UserWarning, match="no Java"):
        assert sorted(models.forest_cv(rows, names, settings).collect()) == found
        alone = sorted(models.forest_cv(rows, names, settings[24:27], importance=True).collect())
    assert calls == [1, 1] and [r[:6] for r in alone] == [r[:6] for r in one]
    assert all(np.allclose(a.gains, b.gains) for a, b in zip(alone, one, strict=True))


def test_forests_of_the_grid_share_their_tasks(spark):
    rows = spark.range(60).selectExpr("cast(id % 7 as double) a", "cast(id % 11 as double) b", "cast(id % 2 as int) label", "id % 3 fold")
    runs = models.forest_cv(rows, ["a", "b"], [{"n": 3, "min_leaf": leaf, "multiplier": m} for leaf in range(1, 10) for m in (0.5, 2.0)])  # more than are grown together, fewer trees than those
    assert runs.groupBy("setting").count().filter("count = 3").count() == 18
    assert runs.filter("true_pos + true_neg + false_pos + false_neg = 20").count() == 54


def test_seeds_of_the_best_settings_run_together(spark):
    """Each of the best settings grew its forests alone, too slowly for 1 GB; one run of all finds the same."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(*map(float, r), int(r[0] + rng.normal() > 0), i % 3) for i, r in enumerate(rng.normal(size=(90, 4)))], "a double, b double, c double, d double, label int, fold long")
    settings = [{"n": 5, "max_depth": d, "min_leaf": leaf, "multiplier": 1.0} for d, leaf in ((None, 1), (2, 1), (None, 4))]
    runs = models.seed_runs(rows, list("abcd"), "rf", (1, 2, 3), settings)
    assert len(runs[0]) == 9 and runs[1].count() == 27
    for s in settings:
        assert models.seed_stability(rows, list("abcd"), "rf", (1, 2, 3), runs=runs, **s).collect() == models.seed_stability(rows, list("abcd"), "rf", (1, 2, 3), **s).collect()
    assert models.seed_runs(rows, list("abcd"), "gbt", (1,), settings) is None
