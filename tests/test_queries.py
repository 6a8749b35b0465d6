"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import math
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from tesselon import registry

SF = "/root/testdata/sf0.001"
SLOW = {"mlp_probe_cv", "dense_predict", "feature_table"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def shown(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(shown, r)) for r in df[columns].itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_models(spark, tmp_path):
    from tesselon.operators import evaluation, models
    from tesselon.plans.model_queries import FEATURES, labelled

    rows = labelled(spark, SF)
    folds, fitted = models.grouped_cv(rows, FEATURES[:4], "rf", n=5, max_depth=3)
    assert folds.count() == rows.select("fold").distinct().count() and evaluation.pooled(folds).first().pooled_accuracy > 0.3
    assert models.importances(spark, fitted, FEATURES[:4]).count() == 4
    models.save(fitted[0], str(tmp_path / "m"), features=FEATURES[:4], epoch=3)
    again, about = models.load(str(tmp_path / "m"))
    assert about == {"features": FEATURES[:4], "epoch": 3} and models.score(again, rows).select("prob").exceptAll(models.score(fitted[0], rows).select("prob")).count() == 0
    with pytest.raises(ValueError, match="f0"):
        models.score(fitted[0], rows.drop("f0"))
    for kind, p in (("linear", {"n": 10}), ("mlp", {"n": 5, "hidden": 4}), ("gbt", {"n": 2, "max_depth": 2})):
        assert "prob" in models.score(models.build_model(kind, FEATURES[:4], **p).fit(models.weighted(rows)), rows).columns
    with pytest.raises(ValueError):
        models.build_model("svm", FEATURES)


def test_model_queries_do_the_whole_job(spark, monkeypatch):
    from tesselon.plans import model_queries as q

    asked, seeds, schema = [], [], "max_depth double, min_leaf double, class_weight_multiplier double"

    def grid(rows, features, kind, grid, multipliers, **fixed):
        asked.append((len(features), math.prod(map(len, grid.values())) * len(multipliers), None in grid["max_depth"], fixed["n"]))
        return spark.createDataFrame([(None, 1.0, 0.5), (3.0, 2.0, 1.0), (5.0, 5.0, 1.5), (8.0, 1.0, 1.0)], schema)

    def stability(rows, features, kind, of, **p):
        seeds.append((tuple(of), p["max_depth"], p["min_leaf"], p["multiplier"], p["n"]))
        return spark.createDataFrame([(0.5, 0.1, len(of))], "mean double, std double, seeds long")

    monkeypatch.setattr(q.models, "grid_search", grid)
    monkeypatch.setattr(q.models, "seed_stability", stability)
    assert q.labelled(spark, SF).columns == ["vec_id", *(f"f{i}" for i in range(64)), "label", "fold"]
    q.grid_search(spark, SF)
    assert q.seed_stability(spark, SF).count() == 3
    assert asked == [(64, 48, True, 300)] * 2
    assert seeds == [((1, 2, 3, 4, 5), d, leaf, m, 300) for d, leaf, m in ((None, 1, 0.5), (3, 2, 1.0), (5, 5, 1.5))]


def test_queries_are_listed_without_a_session():
    """Queries and SQL are registered before any session exists, as a driver that lists them needs."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
