"""Fold-safe cross-validation and tuning, neighbours as a model, decisions at a model's own cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import models as ML

COLS = ["a", "b"]


def _rows(spark, n=240, seed=3):
    r = random.Random(seed)
    rows = [(f"k{i:04d}", x, y, int(x + y + r.gauss(0, 0.3) > 0), i % 3)
            for i in range(n) for x, y in [(r.gauss(0, 1), r.gauss(0, 1))]]
    return spark.createDataFrame(rows, "case_key string, a double, b double, label int, fold int").cache()


def test_held_out_rows_do_not_move_a_folds_scaler(spark):
    d = _rows(spark)
    far = d.withColumn("a", F.when(F.col("fold") == 1, F.col("a") + 1e6).otherwise(F.col("a")))
    seen = {}

    def spy(name):
        def fit(train):
            folds = {r["fold"] for r in train.select("fold").distinct().collect()}
            model = ML.fit_logistic(train, COLS, max_iter=20)
            seen[name, *sorted(folds)] = ML.standardised_moments(model)
            return model
        return fit

    ML.cross_validate(d, {"m": spy("near")}, folds=3)
    ML.cross_validate(far, {"m": spy("far")}, folds=3)
    assert seen["near", 0, 2] == seen["far", 0, 2]
    assert seen["near", 1, 2] != seen["far", 1, 2]


def test_margins_are_cut_at_zero(spark):
    d = _rows(spark)
    svm = ML.fit_svm(d, COLS, kernel="linear", max_iter=30)
    assert ML.decision_cut(svm) == 0.0 and ML.decision_cut(ML.fit_tree(d, COLS)) == 0.5
    s = ML.decided(svm, d)
    assert s.where("(score >= 0) <> (prediction = 1)").count() == 0
    assert s.where("score > 0 and score < 0.5").count() > 0
    per = ML.cross_validate(d, {"svm": lambda t: ML.fit_svm(t, COLS, kernel="linear", max_iter=30)}, folds=3)
    assert min(r["accuracy"] for r in per.collect()) > 0.8


def test_neighbours_give_class_one_share(spark):
    d = _rows(spark, 90)
    train, test = d.where("fold > 0"), d.where("fold = 0")
    test = test.unionByName(test.limit(1).withColumn("case_key", F.lit("gap")).withColumn("a", F.lit(None).cast("double")))
    got = {r["case_key"]: r["score"] for r in ML.fit_neighbours(train, COLS, k=4)(test).collect()}
    t = train.toPandas()
    m, s = t[COLS].mean(), t[COLS].std(ddof=0)
    z = ((t[COLS] - m) / s).to_numpy()
    for r in test.collect():
        if r["case_key"] == "gap":
            assert got["gap"] is None
            continue
        x = ((np.array([r["a"], r["b"]]) - m.to_numpy()) / s.to_numpy())
        near = sorted(zip(((z - x) ** 2).sum(1), t["case_key"], t["label"]))[:4]
        assert got[r["case_key"]] == sum(l for _, _, l in near) / 4


def test_grid_search_refits_the_best_setting(spark):
    d = _rows(spark)
    model, table = ML.grid_search(d, COLS, "label", "logistic", [{"C": 1e-9}, {"C": 1.0}, {"C": 1.0}], folds=3)
    rows = table.orderBy("setting").collect()
    assert len(rows) == 3 and rows[1]["roc_auc"] == rows[2]["roc_auc"] > 0.9
    assert ML.standardised_moments(model) == ML.standardised_moments(ML.fit_logistic(d, COLS))
    with pytest.raises(ValueError):
        ML.grid_search(d, COLS, "label", "other", [{}])


def test_three_families_and_five_models(spark):
    d = _rows(spark)
    train, test = d.where("fold < 2"), d.where("fold = 2")
    grids = {"logistic": [{"C": 0.1}, {"C": 1.0}], "forest": [{"n_trees": 5, "max_depth": 3, "min_split": 5}],
             "svm": [{"kernel": "linear", "max_iter": 20}, {"kernel": "rbf", "gamma": "auto", "n_components": 20, "max_iter": 20}]}
    models, m = ML.tune_families(train, test, COLS, grids, folds=2)
    rows = {r["model"]: r for r in m.collect()}
    assert set(rows) == set(models) == set(grids)
    assert all(r["roc_auc"] > 0.85 and r["cv_roc_auc"] > 0.8 for r in rows.values())
    five = ML.evaluate_models(train, test, {
        "lr": lambda t: ML.fit_logistic(t, COLS), "knn": lambda t: ML.fit_neighbours(t, COLS),
        "svm": lambda t: ML.fit_svm(t, COLS, n_components=20, max_iter=20), "tree": lambda t: ML.fit_tree(t, COLS),
        "forest": lambda t: ML.fit_forest(t, COLS, n_trees=5, max_depth=4)})
    assert sorted(r["model"] for r in five.collect()) == ["forest", "knn", "lr", "svm", "tree"]
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == test.count() for r in five.collect())
