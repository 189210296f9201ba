"""Forests grown on counted cells, and factors read off a forest's tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskframe.operators import factors as FA
from riskframe.operators import forest as FO
from riskframe.operators import models as ML

COLS = ["a", "b", "c"]


def _rows(spark, n=1500, seed=11):
    r = random.Random(seed)
    rows = [(f"k{i:05d}", x, y, float(r.randint(0, 4)), int(x + y + r.gauss(0, 0.2) > 0)) for i in range(n) for x, y in [(r.gauss(0, 1), r.gauss(0, 1))]]
    return spark.createDataFrame(rows, "case_key string, a double, b double, c double, label int").cache()


def test_cell_forest_is_as_good_as_sparks_and_can_be_saved(spark, monkeypatch, tmp_path):
    d = _rows(spark)
    theirs = ML.fit_forest(d, COLS, n_trees=30, max_depth=6)
    monkeypatch.setattr(FO, "CELL_ROWS", 1)
    ours, again = (ML.fit_forest(d, COLS, n_trees=30, max_depth=6) for _ in range(2))
    a, b = (m.stages[-1].featureImportances.toArray() for m in (theirs, ours))
    assert np.abs(a - b).max() < 0.06 and ours.stages[-1].getNumTrees == 30
    assert 0.5 < ours.stages[-1].totalNumNodes / theirs.stages[-1].totalNumNodes < 2
    assert max(t.depth for t in ours.stages[-1].trees) <= 6
    assert (again.stages[-1].featureImportances.toArray() == b).all()  # a seed gives one forest
    ours.write().overwrite().save(str(tmp_path / "m"))
    right = ML.decided(type(ours).load(str(tmp_path / "m")), d).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.93


def test_cells_hold_every_row_and_the_rest_goes_to_spark(spark, monkeypatch):
    d = _rows(spark, 300)
    x = np.array([[r["a"], r["b"], r["label"]] for r in d.collect()])
    cuts = [FO.feature_cuts(x[:, j], 8) for j in (0, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(p[:, 2]), pa.array(p[:, 0]), pa.array(p[:, 1])], ["y", "x0", "x1"]) for p in np.array_split(x, 3)]
    counted = [b.to_pydict() for b in FO._count_cells(cuts, [(0.0, 1.0)] * 2)(batches)]
    assert (sum(sum(c["n0"]) for c in counted), sum(sum(c["n1"]) for c in counted)) == ((x[:, 2] == 0).sum(), (x[:, 2] == 1).sum())
    assert all(len(c) == 7 for c in cuts) and FO.feature_cuts(np.array([1.0, 3.0, 3.0]), 8).tolist() == [2.0]
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    y = x[:, 2].astype(int)
    tree = FO.grow(bins, 1 - y, y, cuts, (1.0, 1.0), np.random.default_rng(1), 30, 1, 2)
    assert tree[0][0] == 0 and len(tree) > 5 and all(left > i and right > i for i, *_, left, right, _, _ in tree if left >= 0)
    monkeypatch.setattr(FO, "CELL_ROWS", 1)
    with pytest.raises(ValueError, match="missing"):
        ML.fit_forest(d.withColumn("a", F.when(F.col("b") > 0, F.col("a"))), COLS, n_trees=2)
    monkeypatch.setattr(FO, "MAX_CELLS", 3)
    assert ML.fit_forest(d, COLS, n_trees=2).stages[-1].getNumTrees == 2


def test_grid_factors_equal_leaf_factors(spark, monkeypatch):
    rng = np.random.default_rng(4)

    def leaves(box, depth):
        if depth == 0 or rng.random() < 0.15:
            return [(box, float(rng.random()))]
        f, cut = int(rng.integers(4)), float(rng.choice([-1.0, -0.2, 0.3, 0.9]))
        low, high = box.get(f, (-np.inf, np.inf))
        if not low < cut < high:
            return [(box, float(rng.random()))]
        return leaves({**box, f: (low, cut)}, depth - 1) + leaves({**box, f: (cut, high)}, depth - 1)

    trees = [leaves({}, 5) for _ in range(12)]
    x, back = rng.choice([-1.0, -0.5, -0.2, 0.0, 0.3, 0.5, 0.9, 2.0], (200, 4)), rng.normal(size=(9, 4))
    assert np.abs(FA.grid_shap(x, *FA.grid_tables(back, trees, 4)) - FA.tree_shap(x, back, trees)).max() < 1e-12
    monkeypatch.setattr(FA, "MAX_GRID", 10)
    assert FA.grid_tables(back, trees, 4) is None


def test_factors_are_the_same_with_and_without_tables(spark, monkeypatch):
    d = _rows(spark, 200)
    model = ML.fit_forest(d, COLS, n_trees=4, max_depth=4)
    gap = d.limit(1).withColumn("case_key", F.lit("gap")).withColumn("a", F.lit(None).cast("double"))

    def got():
        return {r["case_key"]: r["factors"] and [(s["feature"], s["value"], pytest.approx(s["shap_value"], abs=1e-12)) for s in r["factors"]]
                for r in FA.tree_factors(d.unionByName(gap), d.limit(7), model).collect()}

    tables = got()
    monkeypatch.setattr(FA, "grid_tables", lambda *a: None)
    assert got() == tables and tables["gap"] is None and len(tables) == 201
