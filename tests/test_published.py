"""Calibrated models: written, published, loaded back; missing features; Platt's fit."""

import math
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.functions import scalars as S
from riskframe.operators import models as ML
from riskframe.operators import published as PUB
from riskframe.operators import scoring as SC

FEATS = ["a", "b c"]


def rows(n=400, seed=1):
    rnd = random.Random(seed)
    return [(f"k{i}", (x := rnd.gauss(0, 1)), (y := rnd.gauss(0, 1)), int(x - y + rnd.gauss(0, .3) > 0), i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id string, a double, `b c` double, label int, fold int")


FITS = {"logistic": lambda d: ML.fit_logistic(d, FEATS), "linear": lambda d: ML.fit_svm(d, FEATS, kernel="linear", max_iter=20),
        "fourier": lambda d: ML.fit_svm(d, FEATS, n_components=12, max_iter=10), "tree": lambda d: ML.fit_tree(d, FEATS, max_depth=3)}


@pytest.mark.parametrize("kind", list(FITS))
def test_round_trip(spark, data, kind):
    m = ML.calibrate_sigmoid(data, FITS[kind], folds=3, features=FEATS if kind == "fourier" else None).with_threshold(0.35)
    assert m.features == FEATS
    root = tempfile.mkdtemp(prefix="pub-", dir="/tmp")
    with pytest.raises(FileNotFoundError):
        PUB.load_published(spark, root)
    first = PUB.publish(spark, m, root, {"auc": 0.9})
    second = PUB.publish(spark, m.with_threshold(0.6), root)
    again = PUB.load_published(spark, root, first)
    assert again.threshold == 0.35 and PUB.load_published(spark, root).threshold == 0.6 and first != second
    assert PUB.published(spark, root).where(F.col("version") == first).first()["metrics"] == {"auc": 0.9}
    scored = m(data).select("id", F.col("probability").alias("p")).join(again(data), "id").collect()
    assert len(scored) == 400 and all(r.p == r.probability and 0 <= r.p <= 1 for r in scored)
    # the mean of the folds' sigmoids, from each fold's own pipeline
    want = {r["id"]: [] for r in scored}
    for model, a, b in m.parts:
        out = model.transform(data)
        raw = vector_to_array("probability" if kind == "tree" else "rawPrediction")[1]
        for r in out.select("id", raw.alias("raw")).collect():
            want[r["id"]].append(1 / (1 + math.exp(-(r["raw"] * a + b))))
    assert all(r.p == pytest.approx(sum(want[r["id"]]) / 3, abs=1e-12) for r in scored)
    with pytest.raises(FileNotFoundError):
        PUB.load_published(spark, root, "none")


def test_unfinished_write_is_not_a_model(spark, data):
    m = ML.calibrate_sigmoid(data, FITS["tree"], folds=3)
    path = tempfile.mkdtemp(prefix="half-", dir="/tmp")
    m.folds[0].write().overwrite().save(os.path.join(path, "folds", "0"))  # no manifest yet
    with pytest.raises(FileNotFoundError):
        PUB.CalibratedModel.load(path)
    with pytest.raises(ValueError):
        m.with_threshold(1.2)


def test_missing_features_and_clashing_names(spark, data):
    m = ML.calibrate_sigmoid(data, FITS["logistic"], folds=3)
    nasty = data.limit(4).select("id", F.when(F.col("id") == "k1", None).when(F.col("id") == "k2", float("nan")).otherwise(F.col("a")).alias("a"), "b c",
                                 *[F.lit(c).alias(c) for c in ("features", "rawPrediction", "prediction", "__raw", "__p0", "__z_a", "probability")])
    out = {r["id"]: r for r in m(nasty).collect()}
    plain = {r["id"]: r["probability"] for r in m(data).where("id in ('k0', 'k3')").collect()}
    assert m(nasty).columns == nasty.columns
    assert out["k0"]["probability"] == plain["k0"] and out["k0"]["features"] == "features" and out["k0"]["__p0"] == "__p0"
    assert out["k1"]["probability"] is None and out["k2"]["probability"] is None
    cases = {r["case_key"]: r for r in PUB.score_published(nasty, m, "id").collect()}
    assert cases["k1"]["prediction"] is None and cases["k2"]["risk_level"] is None and cases["k3"]["prediction"] is not None
    assert m(nasty.where("false")).count() == 0


def test_missing_probability_rule(spark):
    d = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (0.5,), (0.9,)], "p double")
    got = [tuple(r) for r in d.select(S.predicted_label("p", 0.5), S.risk_level("p", 0.5)).collect()]
    assert got == [(None, None), (None, None), ("Benign", "Low"), ("Malignant", "Moderate"), ("Malignant", "High")]


def test_uncalibrated_margin_is_refused(spark, data):
    with pytest.raises(ValueError):
        SC.model_scorer(ML.fit_svm(data, FEATS, kernel="linear", max_iter=5), FEATS)(data)


def test_platt_minimises_its_loss(spark):
    rnd = random.Random(4)
    pts = [(rnd.gauss(0, 2), rnd.random()) for _ in range(500)]
    pts = [(s, int(u < 1 / (1 + math.exp(-(1.3 * s - 0.4))))) for s, u in pts]
    a, b = ML.platt(spark.createDataFrame([*pts, (None, 1)], "raw double, label int"))
    s, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    r = 1 / (1 + np.exp(-(a * s + b))) - t
    assert abs((r * s).sum()) < 1e-5 and abs(r.sum()) < 1e-5 and a == pytest.approx(1.3, abs=0.4)
    # separable scores end too, and an empty table has a fixed answer
    a, b = ML.platt(spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "raw double, label int"))
    assert a > 0 and math.isfinite(b)
    assert ML.platt(spark.createDataFrame([], "raw double, label int")) == (0.0, 0.0)
