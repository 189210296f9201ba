"""Metrics micro fixtures (FIXTURES §4) and one-pass sweep / exact AUC properties."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskframe.functions.scalars import arange
from riskframe.operators import metrics as M
from riskframe.operators import select as SEL


def df_of(spark, rows, schema="label int, score double"):
    return spark.createDataFrame(rows, schema)


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = 0.0
    for p, n in itertools.product(pos, neg):
        tot += 1.0 if p > n else 0.5 if p == n else 0.0
    return tot / (len(pos) * len(neg))


def test_auc_ties_half_credit(spark):
    d = df_of(spark, [(0, .1), (0, .4), (1, .4), (1, .8)])
    assert M.roc_auc(d).first()["roc_auc"] == pytest.approx(0.875)


def test_auc_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    got = M.roc_auc(df_of(spark, rows), n_buckets=7).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(rows), abs=1e-12)


def test_auc_single_class_is_null(spark):
    d = df_of(spark, [(1, .1), (1, .5)])
    assert M.roc_auc(d).first()["roc_auc"] is None


def test_auc_grouped(spark):
    rows = [("a", 0, .1), ("a", 1, .9), ("b", 1, .1), ("b", 0, .9)]
    d = spark.createDataFrame(rows, "m string, label int, score double")
    got = {r["m"]: r["roc_auc"] for r in M.roc_auc(d, by=["m"]).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_zero_division_metrics(spark):
    d = df_of(spark, [(1, .1), (0, .2), (1, .3)])
    r = M.threshold_metrics(d, "label", "score", 0.9).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    assert r["tp"] == 0 and r["fn"] == 2 and r["tn"] == 1


def test_threshold_boundary_is_inclusive(spark):
    d = df_of(spark, [(1, .5), (0, .4999)])
    r = M.threshold_metrics(d, "label", "score", 0.5).first()
    assert r["tp"] == 1 and r["tn"] == 1


def test_sweep_equals_naive(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(500)]
    d = df_of(spark, rows)
    grid = arange(0.10, 0.91, 0.01)
    fast = {round(r["threshold"], 9): r for r in M.threshold_sweep(d, grid=grid, with_auc=False).collect()}
    slow = {round(r["threshold"], 9): r for r in M.naive_threshold_sweep(d, "label", "score", grid).collect()}
    assert fast.keys() == slow.keys() and len(fast) == 81
    for t in fast:
        for c in ("tn", "fp", "fn", "tp", "precision", "recall", "f1", "specificity"):
            assert fast[t][c] == pytest.approx(slow[t][c]), (t, c)


def test_grid_float_noise():
    g13, g81 = arange(0.20, 0.81, 0.05), arange(0.10, 0.91, 0.01)
    assert len(g13) == 13 and len(g81) == 81
    assert sum(1 for t in g13 if t == round(t, 2)) == 5
    assert sum(1 for t in g81 if t == round(t, 2)) == 4


def test_f2_default_when_all_zero(spark):
    d = df_of(spark, [(1, 0.0), (0, 0.0), (1, 0.0)])
    r = SEL.select_threshold_fbeta(d).first()
    assert r["selected_threshold"] == 0.5 and r["fbeta"] == 0.0


def test_f2_lowest_threshold_wins_ties(spark):
    d = df_of(spark, [(1, 0.95), (0, 0.05)])
    r = SEL.select_threshold_fbeta(d).first()
    assert r["selected_threshold"] == 0.1 and r["fbeta"] == pytest.approx(1.0)


def test_recommend_no_eligible_fallback(spark):
    sweep = spark.createDataFrame(
        [(0.2, 0.9, 1, 0.5, 0.1), (0.3, 0.9, 1, 0.6, 0.2), (0.4, 0.8, 2, 0.7, 0.3)],
        "threshold double, recall double, fn long, f1 double, specificity double")
    r = SEL.recommend_threshold(sweep, 0.85).first()
    assert r["threshold"] == 0.3 and r["eligible"] is False


def test_recommend_eligible_first(spark):
    sweep = spark.createDataFrame(
        [(0.2, 0.99, 0, 0.5, 0.5), (0.3, 0.9, 1, 0.6, 0.86), (0.4, 0.9, 1, 0.6, 0.9)],
        "threshold double, recall double, fn long, f1 double, specificity double")
    r = SEL.recommend_threshold(sweep, 0.85).first()
    assert r["threshold"] == 0.4 and r["eligible"] is True


def test_choose_candidate_keeps_base_on_tie(spark):
    a = spark.createDataFrame([("base", 0.8, 0.9)], "model string, fbeta double, recall double")
    b = spark.createDataFrame([("aug", 0.8, 0.9)], "model string, fbeta double, recall double")
    assert SEL.choose_candidate(a, b).first()["model"] == "base"
    b2 = spark.createDataFrame([("aug", 0.8, 0.95)], "model string, fbeta double, recall double")
    assert SEL.choose_candidate(a, b2).first()["model"] == "aug"


def test_cv_summary_population_std(spark):
    f = spark.createDataFrame([(0, 1.0), (1, 3.0)], "fold int, accuracy double")
    r = M.cv_summary(f, ["accuracy"]).first()
    assert r["accuracy_mean"] == 2.0 and r["accuracy_std"] == 1.0


def test_class_weights_balanced(spark):
    d = df_of(spark, [(1, .1)] * 1 + [(0, .1)] * 3)
    w = {r["label"]: r["weight"] for r in M.class_weights(d).collect()}
    assert w[1] == pytest.approx(4 / (2 * 1)) and w[0] == pytest.approx(4 / (2 * 3))


def test_roc_curve_matches_drop_intermediate_rule(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 30))) for _ in range(400)]
    rows += [(1, 100.0), (0, 101.0), (1, 102.0), (0, 103.0)]
    got = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in
                 M.roc_curve(df_of(spark, rows), n_buckets=5).collect())
    # reference computation: cumulative counts over decreasing distinct scores
    scores = sorted({s for _, s in rows}, reverse=True)
    pos = {s: sum(1 for y, t in rows if t == s and y == 1) for s in scores}
    neg = {s: sum(1 for y, t in rows if t == s and y == 0) for s in scores}
    P, N = sum(pos.values()), sum(neg.values())
    fps, tps, acc_p, acc_n = [], [], 0, 0
    for s in scores:
        acc_p += pos[s]; acc_n += neg[s]
        tps.append(acc_p); fps.append(acc_n)
    keep = [0] + [i for i in range(1, len(scores) - 1)
                  if fps[i + 1] - 2 * fps[i] + fps[i - 1] != 0 or tps[i + 1] - 2 * tps[i] + tps[i - 1] != 0] \
        + [len(scores) - 1]
    want = sorted([(float("inf"), 0.0, 0.0)] + [(scores[i], fps[i] / N, tps[i] / P) for i in keep])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])


def test_sweep_exchanges_no_scores_and_skips_missing_ones(spark):
    nan = float("nan")
    rows = [(i % 2, i / 100.0) for i in range(100)] + [(1, nan), (0, nan), (1, None), (None, 0.5)]
    d = spark.createDataFrame(rows, "label int, score double")
    grid = [0.2, 0.5, 0.8]
    sweep = M.threshold_sweep(d, "label", "score", grid, with_auc=False)
    shuffles = [x for x in sweep._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert shuffles and not any("score" in x for x in shuffles)
    with_auc = {r["threshold"]: r for r in M.threshold_sweep(d, "label", "score", grid).collect()}
    for r in sweep.collect():
        one = M.threshold_metrics(d, "label", "score", r["threshold"]).first()
        for c in ("tn", "fp", "fn", "tp", "recall"):
            assert r[c] == one[c] == with_auc[r["threshold"]][c]
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == 100
    assert M.roc_auc(d, "label", "score").first()[0] == M.roc_auc(d.where("score < 2"), "label", "score").first()[0]
