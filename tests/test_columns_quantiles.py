"""Projection helpers and exact two-level quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.operators.ranking import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(9)
    rows = [(g, float(rnd.choice([rnd.random(), round(rnd.random(), 1)]))) for g in "ab"
            for _ in range(777 if g == "a" else 31)]
    rows += [("a", None), ("b", float("nan"))]
    d = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))]
           for r in exact_quantiles(d, ["g"], "v", probs, n_buckets=7).collect()}
    for g in "ab":
        vals = np.array([v for k, v in rows if k == g and v is not None and v == v])
        want = np.percentile(vals, [p * 100 for p in probs])
        assert got[g] == pytest.approx(list(want), abs=1e-12)


def test_exact_quantiles_global(spark):
    d = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    r = exact_quantiles(d, [], "v", [0.5, 0.999], n_buckets=13).first()
    assert r["q0"] == 500.0 and r["q1"] == pytest.approx(999.0)


def test_projection_helpers(spark):
    d = spark.createDataFrame([(1, 2.0, 3, "x", 1)], "id int, `mean radius` double, n long, s string, label int")
    assert C.feature_columns(d, "label", ["id"]) == ["mean radius", "n"]
    feats, lab = C.split_features_label(d, "label", ["id"])
    assert "label" not in feats.columns and lab.columns == ["id", "label"]
    assert C.rename(d, {"s": "t"}).columns[3] == "t"
    assert C.missing_columns(d, ["id", "zz", "aa"]) == ["aa", "zz"]
    with pytest.raises(ValueError):
        C.require_columns(d, ["zz"])
    arr = spark.createDataFrame([(7, [1.0, 2.0, 3.0])], "k int, a array<double>")
    r = C.vector_to_columns(arr, "a", ["x", "y", "z"], keep=["k"]).first()
    assert (r["k"], r["x"], r["y"], r["z"]) == (7, 1.0, 2.0, 3.0)
    m = C.unpivot_features(d, ["id"], ["mean radius", "n"]).collect()
    assert sorted((x["feature"], x["value"]) for x in m) == [("mean radius", 2.0), ("n", 3.0)]


def test_exact_quantiles_heavy_value(spark):
    rows = [("g", 0.0)] * 700 + [("g", float(i)) for i in range(1, 301)]
    d = spark.createDataFrame(rows, "g string, v double")
    probs = [0.1, 0.5, 0.7, 0.75, 0.99]
    r = exact_quantiles(d, ["g"], "v", probs, n_buckets=4).first()
    want = np.percentile(np.array([v for _, v in rows]), [p * 100 for p in probs])
    assert [r[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want))
    assert r["n"] == 1000
