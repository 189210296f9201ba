"""Fits taken together or side by side, margins and copula ranks without a row-wise search."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import models as ML
from riskframe.operators import published as PUB
from riskframe.operators import synth as SY

COLS = ["a", "b"]


def _rows(spark, n=150, seed=5):
    r = random.Random(seed)
    rows = [(f"k{i:04d}", x, y, int(x + y + r.gauss(0, 0.5) > 0), i % 3)
            for i in range(n) for x, y in [(r.gauss(3, 2), r.gauss(0, 1))]]
    return spark.createDataFrame(rows, "case_key string, a double, b double, label int, fold int").cache()


def test_grid_scores_equal_single_fits(spark, monkeypatch):
    d, grid = _rows(spark), [{"C": 1.0}, {"regParam": 0.1}]
    for balanced in (False, True):
        got = ML._grid_scores(d, COLS, "label", grid, "fold", 3, balanced)
        for i, setting in enumerate(grid):
            _, held = ML._held_out(d, lambda t: ML.fit_logistic(t, COLS, balanced=balanced, **setting), "label", "fold", None, 3, 1)  # noqa: B023
            a, b = (sorted((r["fold"], r["label"], r["score"]) for r in x.collect()) for x in (got(i), held))
            assert len(a) == len(b) == 150
            assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-5 for x, y in zip(a, b))
        got.rows.unpersist()
    fits = []
    monkeypatch.setitem(ML.FAMILIES, "logistic", lambda *a, **k: fits.append(k) or ML.fit_logistic(*a, **k))
    ML.grid_search(d, COLS, "label", "logistic", grid, folds=3)
    assert len(fits) == 1  # the refit alone


def test_grid_scores_leave_other_cases_to_single_fits(spark):
    d = _rows(spark, 30)
    one = [{"C": 1.0}]
    assert ML._grid_scores(d, COLS, "label", [{"C": 1.0, "max_iter": 3}], "fold", 3, False) is None
    assert ML._grid_scores(d.withColumn("label", F.col("label") * 2), COLS, "label", one, "fold", 3, False) is None
    assert ML._grid_scores(d.withColumn("label", F.lit(1)), COLS, "label", one, "fold", 3, False) is None
    assert ML._grid_scores(d.withColumn("a", F.when(F.col("b") > 0, F.col("a"))), COLS, "label", one, "fold", 3, False) is None


def test_svm_scores_equal_its_projection(spark):
    d = _rows(spark)
    svm = ML.fit_svm(d, COLS, n_components=8, max_iter=10)
    want = {r["case_key"]: r["rawPrediction"][1] for r in svm.transform(d).collect()}
    scored = ML.positive_score(svm, d)
    assert scored.columns == [*d.columns, "score"]
    assert all(r["score"] == pytest.approx(want[r["case_key"]], abs=1e-9) for r in scored.collect())


def test_linear_margin_is_an_expression(spark):
    d = _rows(spark)
    gap = d.limit(1).withColumn("case_key", F.lit("gap")).withColumn("a", F.lit(None).cast("double"))
    for model in (ML.fit_logistic(d, COLS), ML.fit_svm(d, COLS, kernel="linear", max_iter=20)):
        want = {r["case_key"]: r["rawPrediction"][1] for r in model.transform(d).collect()}
        got = {r["case_key"]: r["raw"] for r in PUB.with_decision(model, d.unionByName(gap), "raw").collect()}
        assert got.pop("gap") is None
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_quantiles_below(spark):
    nan = float("nan")
    rows = [(0, 1.0), (0, 2.5), (0, None), (0, nan), (0, -9.0), (1, 2.5), (2, 2.5), (2, None), (None, 1.0)]
    d = spark.createDataFrame(rows, "n int, x double")
    tables = [[1.0, 2.0, 2.0, 3.0], [2.5, 2.5], None]
    got = d.select(SY.quantiles_below(F.col("n"), F.col("x"), tables).alias("c")).collect()
    assert [r["c"] for r in got] == [1, 3, 0, 4, 0, 2, None, None, None]
