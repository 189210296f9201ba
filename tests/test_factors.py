"""Closed-form factors of trees, forests and additive scorers against the
permutation values over all orders and against subset sums."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import explain as X
from riskframe.operators import factors as FA
from riskframe.operators import models as ML
from riskframe.operators import scoring as SC

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(6)
    rows = [(f"k{i}", rnd.gauss(0, 1), rnd.gauss(0, 2), float(rnd.randrange(5))) for i in range(500)]
    return spark.createDataFrame([(*r, int(r[1] * r[2] + r[3] > 2)) for r in rows], "id string, a double, b double, c double, label int").persist()


@pytest.fixture(scope="module")
def forest(data):
    return ML.fit_forest(data, FEATS, n_trees=7, max_depth=5)


def test_forest_equals_all_orders(spark, data, forest):
    background, cases = data.limit(9), data.orderBy("id").limit(12)
    slow = X.permutation_shap(cases, background, SC.model_scorer(forest, FEATS), FEATS, "id", all_orders=True)
    want = {(r["id"], r["feature"]): r["shap_value"] for r in slow.collect()}
    fast = FA.long_factors(FA.tree_factors(cases, background, forest), "id")
    got = {(r["id"], r["feature"]): r["shap_value"] for r in fast.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("depth", [1, 4])
def test_tree_equals_subset_sums(spark, data, depth):
    tree = ML.fit_tree(data, FEATS, max_depth=depth)
    boxes, mean, dev = FA.leaf_boxes(tree)
    rnd = np.random.default_rng(1)
    x, z = rnd.normal(size=(6, 3)), rnd.normal(size=(5, 3))

    def f(rows):
        inside = lambda r, box: all(lo < r[j] <= hi for j, (lo, hi) in box.items())
        return np.array([sum(v for box, v in boxes[0] if inside(r, box)) for r in rows])
    got = FA.tree_shap(x, z, boxes)
    for i, row in enumerate(x):
        worth = {s: np.mean(f([[row[j] if j in s else b[j] for j in range(3)] for b in z])) for n in range(4) for s in combinations(range(3), n)}
        for j in range(3):
            rest = [k for k in range(3) if k != j]
            want = sum(factorial(n) * factorial(2 - n) / 6 * (worth[tuple(sorted((*s, j)))] - worth[s]) for n in range(3) for s in combinations(rest, n))
            assert got[i, j] == pytest.approx(want, abs=1e-12)


def test_factors_add_up_for_every_row(spark, data, forest):
    background = data.limit(20)
    base = ML.positive_score(forest, background, "p").agg(F.avg("p")).first()[0]
    f = FA.tree_factors(ML.positive_score(forest, data, "probability"), background, forest)
    total = F.aggregate("factors", F.lit(0.0), lambda acc, s: acc + s["shap_value"])
    worst = f.agg(F.max(F.abs(total + F.lit(base) - F.col("probability"))), F.count("factors")).first()
    assert worst[0] < 1e-9 and worst[1] == 500
    assert "Exchange" not in f._jdf.queryExecution().executedPlan().toString()


def test_linear_equals_permutation(spark, data):
    w = {"a": 0.7, "b": -0.2, "c": 0.05}
    background, cases = data.limit(15), data.orderBy("id").limit(5)
    slow = X.permutation_shap(cases, background, SC.expression_scorer(F.expr("0.7 * a - 0.2 * b + 0.05 * c")), FEATS, "id", n_perm=2)
    want = {(r["id"], r["feature"]): r["shap_value"] for r in slow.collect()}
    got = {(r["id"], r["feature"]): r["shap_value"] for r in FA.long_factors(FA.linear_factors(cases, background, w), "id").collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want) and got.keys() == want.keys()


def test_row_functions_equal_the_window_forms(spark):
    rnd = random.Random(3)
    rows = [(f"k{i}", f"mean f{j}", rnd.random(), rnd.choice([0.0, -0.25, 0.25, rnd.gauss(0, 1)])) for i in range(40) for j in range(7)]
    long = spark.createDataFrame(rows, "id string, feature string, value double, shap_value double")
    wide = long.groupBy("id").agg(F.collect_list(F.struct("feature", "value", "shap_value")).alias("factors"))
    pick = lambda d: sorted(map(tuple, d.collect()))
    assert pick(FA.long_top(wide, "id", n=3)) == pick(X.top_factors(long, "id", 3))
    assert pick(FA.long_bars(wide, "id")) == pick(X.factor_bars(long, "id"))


def test_missing_rows_bounds_and_clashes(spark, data, forest):
    nasty = data.limit(3).select("id", F.when(F.col("id") == data.first()["id"], None).otherwise(F.col("a")).alias("a"), "b", "c", F.lit("x").alias("features"), F.lit(1).alias("factors"))
    out = FA.tree_factors(nasty, data.limit(5), forest).collect()
    assert [r["factors"] is None for r in sorted(out, key=lambda r: r["id"] != data.first()["id"])] == [True, False, False]
    assert all(r["features"] == "x" for r in out) and FA.tree_factors(nasty.where("false"), data.limit(5), forest).count() == 0
    with pytest.raises(ValueError):
        FA.background_rows(data.where("false"), FEATS)
    with pytest.raises(ValueError):
        FA.background_rows(spark.range(1001).select(F.col("id").alias("a")), ["a"])
    with pytest.raises(ValueError):
        FA.leaf_boxes(ML.fit_logistic(data, FEATS))


def test_tree_nodes_come_from_one_read(spark):
    from riskframe.operators import factors as FA
    from riskframe.operators import models as ML
    d = spark.range(300).selectExpr("(id * 37) % 101 / 10.0 AS a", "(id * 53) % 97 / 10.0 AS b").selectExpr("*", "CAST(a + b > 9 AS INT) AS label")
    for model in (ML.fit_forest(d, ["a", "b"], n_trees=3), ML.fit_tree(d, ["a", "b"])):
        last = model.stages[-1]
        trees = getattr(last, "trees", [last])
        found, _, _ = FA.leaf_boxes(model)
        assert [len(leaves) for leaves in found] == [(t.numNodes + 1) // 2 for t in trees]
        assert len(FA._tree_nodes(last, len(trees))) == len(trees)
    one = d.repartition(1)
    from riskframe.session import spread
    assert spread(one, 45_000).rdd.getNumPartitions() == 5 and sorted(map(tuple, spread(one).collect())) == sorted(map(tuple, one.collect()))
