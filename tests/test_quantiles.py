"""Two-scan exact quantiles against NumPy, also with a coarse sketch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import profile as P
from riskframe.operators import quantiles as Q

PROBS = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]


def table(spark, n=3000):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        g = rnd.choice(["a", "a", "b", None])
        rows.append((g, rnd.gauss(0, 1), float(rnd.randrange(4)), rnd.choice([None, float("nan"), rnd.expovariate(1), 7.0, 7.0]), None))
    rows += [("solo", 1.5, -2.0, 3.0, None)]
    return rows, spark.createDataFrame(rows, "g string, x double, `d e` double, y double, none double").repartition(5)


def clean(rows, k, g=...):
    return np.array([r[k] for r in rows if (g is ... or r[0] == g) and r[k] is not None and r[k] == r[k]], float)


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_equal_numpy(spark, accuracy):
    rows, d = table(spark)
    cols = ["x", "d e", "y", "none"]
    for by in ([], ["g"]):
        stats, placed = Q.exact_distribution(d, cols, by, PROBS, accuracy)
        got = {(r["g"] if by else ..., r["feature"]): r for r in stats.collect()}
        assert len(got) == (4 if not by else 16)
        for (g, c), r in got.items():
            v = clean(rows, 1 + cols.index(c), g)
            assert r["n"] == len(v)
            assert r["q"] is None if not len(v) else r["q"] == pytest.approx(np.quantile(v, PROBS).tolist(), abs=1e-12)
        assert placed.agg(F.sum("c")).first()[0] == sum(len(clean(rows, k)) for k in (1, 2, 3))
    if accuracy == 10_000:  # a plan reads the table twice: the sketches, then the brackets
        assert Q.sketches(d, cols, [], PROBS)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_missed_rank_widens_the_bracket(spark, monkeypatch):
    rows, d = table(spark)
    real = Q.sketches
    wrong = lambda *a, **k: real(*a, **k).withColumn("low", F.transform("low", lambda v: v + 5)).withColumn("high", F.transform("high", lambda v: v + 5))
    monkeypatch.setattr(Q, "sketches", wrong)
    stats, _ = Q.exact_distribution(d, ["x"], [], [0.5])
    assert stats.first()["q"][0] == pytest.approx(np.quantile(clean(rows, 1), 0.5), abs=1e-12)


def test_empty_and_constant(spark):
    _, d = table(spark, 10)
    r = P.describe_features(d.where("false"), ["x"]).first()
    assert r["count"] == 0 and r["p50"] is None and r["min"] is None
    r = P.describe_features(spark.range(50).select(F.lit(4.0).alias("x")), ["x"]).first()
    assert (r["count"], r["p25"], r["p75"], r["std"]) == (50, 4.0, 4.0, 0.0)
    assert Q.exact_distribution(d.where("false"), ["x"], ["g"], [0.5])[1].count() == 0
