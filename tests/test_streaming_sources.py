"""Batch = stream for K1/K2; artifacts round trip; profile micro tables."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskframe.operators import profile as P
from riskframe.operators import scoring as SC
from riskframe.sources import artifacts as AR
from riskframe.sources import tables as T
from riskframe.streaming import scoring as ST

FEATS = [f"f{i}" for i in range(30)]


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src = os.path.join(base, "in")
    os.makedirs(src)
    rows = []
    for i in range(40):
        n = 29 if i % 7 == 0 else 30
        rows.append({"request_id": f"r{i}", "body": json.dumps({"features": [i / 100.0] * n})})
    for k in range(2):
        with open(os.path.join(src, f"part{k}.json"), "w") as fh:
            for r in rows[k::2]:
                fh.write(json.dumps(r) + "\n")
    scorer = SC.expression_scorer(F.col("f0") * 2)
    stream = spark.readStream.schema("request_id string, body string").json(src)
    q = ST.score_stream(stream, scorer, 0.5, FEATS, os.path.join(base, "out"),
                        os.path.join(base, "rej"), os.path.join(base, "ckpt"), available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(base, "out")).drop("batch_id")
    batch, rej = ST.score_requests_batch(spark.read.schema("request_id string, body string").json(src),
                                         scorer, 0.5, FEATS)
    cols = ["case_key", "probability", "prediction", "risk_level"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert spark.read.parquet(os.path.join(base, "rej")).count() == rej.count() == 6


def test_audit_stream_append(spark):
    base = tempfile.mkdtemp(prefix="audit-", dir="/tmp")
    src = os.path.join(base, "in")
    spark.createDataFrame([("2024-01-01 00:00:00", "C1", "PREDICTION_CREATED", "x")],
                          "Timestamp string, Case_ID string, Event_Type string, Details string") \
         .withColumn("Timestamp", F.to_timestamp("Timestamp")).write.parquet(src)
    ev = spark.readStream.schema("Timestamp timestamp, Case_ID string, Event_Type string, Details string") \
        .parquet(src)
    q = ST.audit_stream(ev, os.path.join(base, "audit"), os.path.join(base, "ck"), available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(base, "audit")).count() == 1


def test_artifacts_round_trip(spark):
    from riskframe.operators import models as ML
    root = tempfile.mkdtemp(prefix="art-", dir="/tmp")
    d = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, label int")
    m = ML.fit_logistic(d, ["x"], "label")
    v = AR.save_model(m, root, "v1")
    loaded = AR.load_model(spark, root)
    assert ML.positive_score(loaded, d).count() == 12
    AR.save_threshold(spark, root, v, 0.42)
    assert AR.load_threshold(spark, root, v) == 0.42
    with pytest.raises(ValueError):
        AR.save_threshold(spark, root, v, 1.5)
    with pytest.raises(FileNotFoundError):
        AR.load_model(spark, os.path.join(root, "nothing"))
    rid = AR.log_run(spark, root, {"stage": "t"}, {"C": 1}, {"auc": 0.9})
    r = AR.read_runs(spark, root).where(F.col("run_id") == rid).first()
    assert r["tags"]["stage"] == "t" and r["metrics"]["auc"] == 0.9


def test_tables_latest_file(spark):
    root = tempfile.mkdtemp(prefix="tbl-", dir="/tmp")
    p = os.path.join(root, "recs")
    T.append_log(spark.createDataFrame([("a",)], "Case_ID string"), p)
    import time
    time.sleep(1.1)
    T.append_log(spark.createDataFrame([("b",)], "Case_ID string"), p)
    assert [r[0] for r in T.latest_file_rows(spark, p).select("Case_ID").collect()] == ["b"]


def test_quality_and_duplicates(spark):
    d = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 2.0, 0), (None, float("nan"), 1)],
                              "a double, b double, label int")
    q = {r["metric"]: r["value"] for r in P.quality_report(d, "label", ["a", "b"]).collect()}
    assert q == {"rows": 3, "input_features": 2, "missing_values": 2, "duplicate_rows": 1,
                 "malignant_records": 2, "benign_records": 1}


def test_kde_integrates_to_one(spark):
    d = spark.createDataFrame([(float(i % 17), i % 2) for i in range(400)], "x double, label int")
    k = P.kde(d, ["x"], "label", grid_n=400).collect()
    for lab in (0, 1):
        pts = sorted((r["x"], r["density"]) for r in k if r["label"] == lab)
        area = sum((pts[i + 1][0] - pts[i][0]) * (pts[i + 1][1] + pts[i][1]) / 2
                   for i in range(len(pts) - 1))
        assert area == pytest.approx(1.0, abs=0.01)


def test_kde_binned_close_to_exact(spark):
    import random
    rnd = random.Random(2)
    d = spark.createDataFrame([(rnd.gauss(0, 1), 0) for _ in range(3000)], "x double, label int")
    ex = {r["grid_index"]: r["density"] for r in P.kde(d, ["x"], "label").collect()}
    bn = {r["grid_index"]: r["density"] for r in P.kde(d, ["x"], "label", bins=400).collect()}
    assert max(abs(ex[i] - bn[i]) for i in ex) < 0.01
