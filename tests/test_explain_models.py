"""Explanations (additivity, closed form), models on planted signal, copula
fidelity, kNN against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import explain as X
from riskframe.operators import metrics as M
from riskframe.operators import models as ML
from riskframe.operators import scoring as SC
from riskframe.operators import synth as SY

FEATS = ["a", "b", "c"]


def planted(spark, n=2000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)
        rows.append((f"r{i}", a, b, c, int(2 * a - b > 0.3)))
    return spark.createDataFrame(rows, "id string, a double, b double, c double, label int")


def test_shap_closed_form_and_additivity(spark):
    d = planted(spark, 60)
    bg, ex = d.limit(15), d.orderBy("id").limit(5)
    w = {"a": 0.7, "b": -0.2, "c": 0.05}
    scorer = SC.expression_scorer(F.expr("0.7 * a - 0.2 * b + 0.05 * c + 0.1"))
    got = {(r["id"], r["feature"]): r["shap_value"]
           for r in X.permutation_shap(ex, bg, scorer, FEATS, "id", n_perm=3).collect()}
    exact = {(r["id"], r["feature"]): r["shap_value"] for r in X.linear_shap(ex, bg, w, "id").collect()}
    assert got.keys() == exact.keys()
    for k in got:
        assert got[k] == pytest.approx(exact[k], abs=1e-12)


def test_shap_sum_equals_score_nonlinear(spark):
    d = planted(spark, 40)
    bg, ex = d.limit(10), d.orderBy("id").limit(4)
    scorer = SC.expression_scorer(F.expr("1 / (1 + exp(-(a * b + c * c - a)))"))
    sh = X.permutation_shap(ex, bg, scorer, FEATS, "id", n_perm=4)
    tot = sh.groupBy("id").agg(F.sum("shap_value").alias("s"), F.first("base_value").alias("b"))
    f = scorer(ex).select("id", "probability")
    for r in tot.join(f, "id").collect():
        assert r["b"] + r["s"] == pytest.approx(r["probability"], abs=1e-12)


def test_top_factors_and_bars(spark):
    f = spark.createDataFrame([("x", "mean radius", 1.0, -0.5), ("x", "b", 2.0, 0.2),
                               ("x", "c", 3.0, 0.0)], "id string, feature string, value double, shap_value double")
    t = X.top_factors(f, "id", 2).orderBy("rank").collect()
    assert [r["feature"] for r in t] == ["mean radius", "b"]
    assert t[0]["direction"] == "reduces malignant risk"
    bars = {r["feature"]: r["bar_pct"] for r in X.factor_bars(f, "id").collect()}
    assert bars == {"mean radius": 100.0, "b": pytest.approx(40.0), "c": 0.0}


def test_logistic_recovers_planted_signal(spark):
    d = planted(spark)
    model = ML.fit_logistic(d, FEATS, "label", C=10.0)
    coef = dict(ML.coefficients(model, FEATS))
    assert coef["a"] > 0 and coef["b"] < 0 and abs(coef["c"]) < 0.5 * abs(coef["b"])
    auc = M.roc_auc(ML.positive_score(model, d)).first()["roc_auc"]
    assert auc > 0.97


def test_logistic_matches_newton(spark):
    """Spark's solution equals an independent Newton solve of the same
    objective C * sum w_i loss_i + |beta|^2 / 2 on standardised features."""
    d = planted(spark, 400, seed=11)
    C = 0.5
    model = ML.fit_logistic(d, FEATS, "label", C=C, balanced=True)
    pdf = d.toPandas()
    X_ = pdf[FEATS].to_numpy()
    X_ = (X_ - X_.mean(0)) / X_.std(0)
    y = pdf["label"].to_numpy()
    n1 = y.sum()
    w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    Xb = np.hstack([np.ones((len(y), 1)), X_])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-Xb @ beta))
        g = C * Xb.T @ (w * (p - y)) + np.r_[0, beta[1:]]
        H = C * (Xb * (w * p * (1 - p))[:, None]).T @ Xb + np.diag([0, 1, 1, 1])
        beta -= np.linalg.solve(H, g)
    got = [v for _, v in ML.coefficients(model, FEATS)]
    assert np.allclose(got, beta, atol=1e-5)


def test_tree_and_forest_importance(spark):
    d = planted(spark)
    for model in (ML.fit_tree(d, FEATS), ML.fit_forest(d, FEATS, n_trees=20)):
        imp = ML.feature_importance(spark, model, FEATS).collect()
        assert imp[0]["feature"] in ("a", "b") and imp[-1]["feature"] == "c"


def test_svm_rff_and_calibration(spark):
    d = planted(spark, 800).withColumn("fold", (F.abs(F.hash("id")) % 3).cast("int"))
    scorer = ML.calibrate_sigmoid(d, lambda t: ML.fit_svm(t, FEATS, n_components=40, max_iter=30),
                                  folds=3)
    s = scorer(d)
    r = s.agg(F.min("probability"), F.max("probability")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0
    assert M.roc_auc(s, "label", "probability").first()["roc_auc"] > 0.9


def test_knn_matches_brute_force(spark):
    rnd = random.Random(5)
    tr = [(i, [rnd.random() for _ in range(3)], rnd.randint(0, 2)) for i in range(60)]
    te = [(100 + i, [rnd.random() for _ in range(3)], 0) for i in range(10)]
    schema = "id long, vec array<double>, label int"
    got = {r["id"]: (r["predicted"], r["probability"]) for r in
           ML.knn_classify(spark.createDataFrame(tr, schema), spark.createDataFrame(te, schema),
                           5, "id", "vec", "label", block_rows=16).collect()}
    for qid, qv, _ in te:
        nn = sorted(tr, key=lambda t: (sum((a - b) ** 2 for a, b in zip(t[1], qv)), t[0]))[:5]
        votes = {}
        for t in nn:
            votes[t[2]] = votes.get(t[2], 0) + 1
        best = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        assert got[qid] == (best[0], best[1] / 5)


def test_copula_fidelity(spark):
    d = planted(spark, 3000).select(*FEATS, "label")
    syn = SY.synthesise(spark, d, FEATS, 4000, "label", seed=1)
    assert syn.count() == 4000
    real_pos = d.agg(F.avg("label")).first()[0]
    assert syn.agg(F.avg("label")).first()[0] == pytest.approx(real_pos, abs=1e-3)
    r = d.agg(F.corr("a", "b")).first()[0]
    s = syn.agg(F.corr("a", "b")).first()[0]
    assert abs(r - s) < 0.1
    for c in FEATS:
        assert syn.agg(F.avg(c)).first()[0] == pytest.approx(d.agg(F.avg(c)).first()[0], abs=0.1)


def test_norm_functions(spark):
    row = spark.range(1).select(SY.norm_ppf(F.lit(0.975)).alias("z"),
                                SY.norm_cdf(F.lit(1.959963984540054)).alias("p")).first()
    assert row["z"] == pytest.approx(1.959963984540054, abs=1e-8)
    assert row["p"] == pytest.approx(0.975, abs=2e-7)


def test_explain_report_tables(spark):
    d = planted(spark, 50)
    rep = X.explain_report(d.orderBy("id").limit(3), d.limit(8),
                           SC.expression_scorer(F.expr("0.3 * a + 0.1 * b")), FEATS, "id",
                           d.select("id", "label"), "label", n_perm=2, top_n=2)
    assert set(rep) == {"global_importance", "local_factors", "local_prediction"}
    assert rep["global_importance"].first()["feature"] == "a"
    assert rep["local_factors"].count() == 6
    assert rep["local_prediction"].count() == 3


def test_nearest_rows_search_few_cells_and_lose_nothing(spark):
    rnd = random.Random(9)

    def vec():
        return [float(rnd.randint(0, 4)), rnd.randint(0, 3) / 7, rnd.gauss(0, 1), rnd.gauss(0, 1)]
    tr = [(f"t{i:05d}", vec(), i % 3) for i in range(1500)]
    tr += [(f"s{i:05d}", [1.0, 0.0, 0.25, 0.25], 1) for i in range(400)]  # one vector many rows share
    te = [(f"q{i:04d}", vec()) for i in range(150)] + [("far", [90.0, 0.0, 0.0, -50.0]), ("at", [1.0, 0.0, 0.25, 0.25])]
    train = spark.createDataFrame(tr, "id string, vec array<double>, label int")
    test = spark.createDataFrame(te, "id string, vec array<double>")
    kept = []
    near = ML.nearest_rows(train, test, 5, "id", "vec", "label", block_rows=16, cell_rows=16, kept=kept)
    got = {}
    for r in near.orderBy("qid", "d", "tid").collect():
        got.setdefault(r["qid"], []).append((r["d"], r["tid"]))
    for qid, q in te:
        want = []
        for tid, v, _ in tr:
            d = 0.0
            for a, b in zip(v, q):
                d += (a - b) * (a - b)
            want.append((d, tid))
        assert got[qid] == sorted(want)[:5]
    placed, home = kept
    cells = placed.select("cell").distinct().count()
    assert cells > 40 and placed.where("tid like 's%'").count() == 5
    assert home.agg(F.avg(F.size("cells"))).first()[0] < cells / 2  # all pairs of blocks would be every cell
