"""Networks of one hidden layer, a whole fit a task: gradients, the loss that MLlib reaches, and folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import models, network


def test_gradient_is_that_of_the_loss(monkeypatch):
    rng = np.random.default_rng(0)
    x, label, weights = rng.normal(size=(50, 3)), (rng.random(50) > 0.5).astype(float), network.first_weights(3, 4, 1)
    value, gradient = network.loss(weights, x, label, 4)
    p = network.probability(weights, x, 4)
    assert value == pytest.approx(-np.log(np.where(label == 1, p, 1 - p)).mean())
    for i in range(len(weights)):
        step = np.eye(len(weights))[i] * 1e-6
        slope = (network.loss(weights + step, x, label, 4)[0] - network.loss(weights - step, x, label, 4)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-7)
    monkeypatch.setattr(network, "ROWS_AT_ONCE", 7)
    assert np.allclose(network.loss(weights, x, label, 4)[1], gradient)


def test_fits_as_well_as_mllib(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    label = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(300) < 0.1)).astype(float)
    rows = spark.createDataFrame([(*map(float, r), int(y)) for r, y in zip(x, label, strict=True)], "a double, b double, c double, d double, label int")
    theirs = models.build_model("mlp", list("abcd"), n=200, hidden=6).fit(models.weighted(rows))
    q = np.array([r.prob for r in models.score(theirs, rows).select("prob").collect()])
    of = lambda p: -np.log(np.clip(np.where(label == 1, p, 1 - p), 1e-12, 1)).mean()
    ours = [of(network.probability(network.fit(x, label, 6, 200, seed), x, 6)) for seed in range(3)]
    assert min(ours) < of(q) + 0.02 and max(ours) < of(q) + 0.1
    few = [of(network.probability(network.fit(x, label, 6, n, 0), x, 6)) for n in (1, 5, 25)]
    assert few[0] > few[1] > few[2] > ours[0]


def test_small_tables_need_no_job_an_iteration(spark, monkeypatch):
    """200 iterations of 10 folds ran a job each, too many for the time given."""
    rows = spark.range(400).select(*[F.sin(F.col("id") * k).alias(f) for k, f in ((1.1, "a"), (2.3, "b"))], (F.col("id") % 5).alias("fold"))
    rows = rows.withColumn("label", (F.col("a") * F.col("b") > 0).cast("int"))
    with monkeypatch.context() as m:
        m.setattr(models, "grouped_cv", lambda *a, **p: pytest.fail("a distributed fit a fold"))
        found = models.mlp_cv(rows, ["a", "b"], n=100, hidden=8).orderBy("fold").collect()
    assert [r.fold for r in found] == list(range(5)) and all(r.true_pos + r.true_neg + r.false_pos + r.false_neg == 80 and r.accuracy > 0.85 for r in found)
    monkeypatch.setattr(network, "SMALL_BYTES", 0)
    large = models.mlp_cv(rows, ["a", "b"], n=100, hidden=8)
    assert large.columns == list(found[0].asDict()) and large.count() == 5 and large.agg(F.min("accuracy")).first()[0] > 0.85
    monkeypatch.undo()
    with pytest.raises(ValueError, match="NaN"):
        models.mlp_cv(rows.withColumn("a", F.lit(float("nan"))), ["a", "b"])
