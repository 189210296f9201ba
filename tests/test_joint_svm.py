"""SVM fits of all folds in one pass a step: equal to Spark's own, few jobs, nothing projected kept."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from riskframe.operators import metrics as M
from riskframe.operators import models as ML
from riskframe.operators import svm as V

COLS = ["a", "b"]


def _rows(spark, n=180, seed=7):
    r = random.Random(seed)
    rows = [(f"k{i:04d}", x, y, int(x * y + r.gauss(0, 0.3) > 0.4), i % 3) for i in range(n) for x, y in [(r.gauss(3, 2), r.gauss(0, 1))]]
    return spark.createDataFrame(rows, "case_key string, a double, b double, label int, fold int").repartition(3).cache()


def test_cos_turns():
    x = np.random.default_rng(1).uniform(-9, 9, 5000)
    assert np.abs(V.cos_turns(x.copy()) - np.cos(2 * np.pi * x)).max() < 1e-13


def test_fold_models_equal_linear_svc(spark):
    d = _rows(spark)
    for balanced, k in ((True, 0), (False, 2)):
        model = ML.FourierSvm(COLS, n_components=12, max_iter=25, balanced=balanced).of_folds(d, "fold", 3)[k]
        own = d.where(F.col("fold") != k)
        own = (M.with_class_weight(own, "label", "_w") if balanced else own.withColumn("_w", F.lit(1.0))).cache()
        x = own
        for stage in model.stages[:3]:
            x = stage.transform(x)
        last = model.stages[-1]
        want = LinearSVC(weightCol="_w", regParam=last.getRegParam(), standardization=False, maxIter=25).fit(x.cache())
        assert last.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-8)
        assert last.intercept == pytest.approx(want.intercept, abs=1e-8)
        assert ML.standardised_moments(model) == {c: pytest.approx(v) for c, v in ML.standard_stats(own, COLS).items()}


def test_folds_share_their_passes(spark, monkeypatch):
    passes, real = [], V._summed
    monkeypatch.setattr(V, "_summed", lambda *a: passes.append(1) or real(*a))
    ML.calibrate_sigmoid(_rows(spark), ML.FourierSvm(COLS, n_components=8, max_iter=10), folds=3)
    assert len(passes) < 3 * 10  # fits of their own take at least a pass a step and fold


def test_missing_features_labels_and_rows_are_errors(spark):
    d, fit = _rows(spark), ML.FourierSvm(COLS, n_components=4, max_iter=2)
    with pytest.raises(ValueError, match="missing"):
        fit(d.withColumn("a", F.when(F.col("b") > 0, F.col("a"))))
    with pytest.raises(ValueError, match="labels"):
        fit(d.withColumn("label", F.col("label") + 1))
    with pytest.raises(ValueError, match="no training rows"):
        fit.of_folds(d.withColumn("fold", F.lit(0)), "fold", 1)


def test_platt_of_folds_equals_each_alone(spark):
    d = _rows(spark).select("fold", "label", F.col("a").alias("raw"))
    got = ML.platt_folds(d, 4, "label", "raw")
    assert got[3] == (0.0, 0.0)
    for k in range(3):
        assert got[k] == pytest.approx(ML.platt(d.where(F.col("fold") == k), "label", "raw"), abs=1e-9)
