"""Split sizes, disjointness, fold balance, exact rank."""

import hashlib

from pyspark.sql import functions as F

from riskframe.operators import sampling as SM
from riskframe.operators.ranking import hash_order_key, rank_within


def test_alloc_569(spark):
    rows = [(i, 0) for i in range(357)] + [(1000 + i, 1) for i in range(212)]
    d = spark.createDataFrame(rows, "id long, label int")
    q = {r["label"]: r["test_quota"] for r in SM.class_quotas(d, "label", 0.2).collect()}
    assert q == {0: 72, 1: 42}
    s = SM.stratified_holdout(d, "label", 0.2, "id", 42)
    got = {(r["split"], r["label"]): r["n"] for r in
           s.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    assert got[("test", 0)] == 72 and got[("test", 1)] == 42
    assert got[("train", 0)] == 285 and got[("train", 1)] == 170


def test_holdout_is_md5_order(spark):
    d = spark.createDataFrame([(i, i % 2) for i in range(50)], "id long, label int")
    s = SM.stratified_holdout(d, "label", 0.2, "id", 42).where("split = 'test'").collect()
    for lab in (0, 1):
        ids = sorted((i for i in range(50) if i % 2 == lab),
                     key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), str(i)))
        assert {r["id"] for r in s if r["label"] == lab} == set(ids[:5])


def test_rank_within_exact(spark):
    d = spark.createDataFrame([(f"k{i}", i % 3) for i in range(400)], "key string, g int")
    d = d.withColumn("h", hash_order_key(F.col("key"), 1))
    r = rank_within(d, ["g"], "h", "key", hex_digits=1).collect()
    for g in range(3):
        mine = sorted((x for x in r if x["g"] == g), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(1, len(mine) + 1))
        assert [x["h"] for x in mine] == sorted(x["h"] for x in mine)


def test_train_validation_test_disjoint(spark):
    d = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "id long, label int")
    s = SM.train_validation_test(d, "label", 0.2, 0.2, "id", 42)
    assert s.count() == 300 and s.select("id").distinct().count() == 300
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n["test"] == 60 and n["validation"] == 48 and n["train"] == 192


def test_kfold_balance(spark):
    d = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(203)], "id long, label int")
    for f in (SM.stratified_kfold(d, "label", 5, "id"), SM.kfold_ordered(d, "label", 5, "id")):
        c = f.groupBy("label", "fold").count().collect()
        for lab in (0, 1):
            sizes = [r["count"] for r in c if r["label"] == lab]
            assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_kfold_ordered_contiguous(spark):
    d = spark.createDataFrame([(i, 0) for i in range(10)], "id long, label int")
    got = [r["fold"] for r in SM.kfold_ordered(d, "label", 5, "id").orderBy("id").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_sample_n_exact(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    assert SM.sample_n(d, 20, "k").count() == 20
    assert SM.sample_n(d, 500, "k").count() == 100


def test_shuffle_rank_is_permutation(spark):
    d = spark.range(257).withColumnRenamed("id", "k")
    r = [x["shuffle_rank"] for x in SM.shuffle_rank(d, "k").collect()]
    assert sorted(r) == list(range(1, 258))


def test_sample_n_large_path_equals_top_n(spark, monkeypatch):
    d = spark.range(500).withColumnRenamed("id", "k")
    small = {r["k"] for r in SM.sample_n(d, 120, "k").collect()}
    monkeypatch.setattr(SM, "TOP_N_LIMIT", 10)
    large = {r["k"] for r in SM.sample_n(d, 120, "k").collect()}
    assert small == large and len(small) == 120


def _first(rows, quota, seed):
    rows = sorted(rows, key=lambda k: hashlib.md5(f"{seed}|{k}".encode()).hexdigest())
    return set(rows[:quota])


def test_select_first_moves_no_rows(spark):
    d = spark.range(4000).select("id", (F.col("id") % 3).cast("int").alias("label"), F.concat(F.lit("p"), "id").alias("payload"))
    s = SM.stratified_holdout(d, "label", 0.2, "id", 42)
    rows, cutoffs = s._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation", 1)
    assert "payload" in rows and not any(x in rows for x in ("Window", "Aggregate", "Sort", "Repartition"))
    assert "payload" not in cutoffs
    got = {r["id"] for r in s.where("split = 'test'").collect()}
    quota = {r["label"]: r["test_quota"] for r in SM.class_quotas(d, "label", 0.2).collect()}
    assert got == set().union(*(_first(range(c, 4000, 3), quota[c], 42) for c in range(3)))


def test_split_with_repeated_null_and_hot_keys(spark):
    rows = [("hot", 0, i) for i in range(700)] + [(None, 0, i) for i in range(100)]
    rows += [(f"k{i}", 0, i) for i in range(200)] + [("hot", None, i) for i in range(50)]
    d = spark.createDataFrame(rows, "id string, label int, n int")
    for frac in (0.05, 0.2, 0.5, 0.95):
        s = SM.stratified_holdout(d, "label", frac, "id", 42)
        q = {r["label"]: r["test_quota"] for r in SM.class_quotas(d, "label", frac).collect()}
        n = {r["label"]: r["count"] for r in s.where("split = 'test'").groupBy("label").count().collect()}
        assert n == {k: v for k, v in q.items() if v} and s.count() == len(rows)
        assert s.distinct().count() == d.distinct().count()


def test_split_of_identical_rows_and_of_no_rows(spark):
    d = spark.createDataFrame([(1, 1)] * 90 + [(2, 0)] * 10, "id long, label int")
    s = SM.stratified_holdout(d, "label", 0.2, "id", 7).where("split = 'test'")
    assert {r["label"]: r["count"] for r in s.groupBy("label").count().collect()} == {1: 18, 0: 2}
    none = SM.train_validation_test(d.where("id > 5"), "label", 0.2, 0.2, "id", 7)
    assert none.columns == ["id", "label", "split"] and none.count() == 0


def test_nested_split_equals_two_splits(spark):
    d = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(700)], "id long, label int")
    both = {r["id"]: r["split"] for r in SM.train_validation_test(d, "label", 0.2, 0.25, "id", 42).collect()}
    outer = SM.stratified_holdout(d, "label", 0.2, "id", 42)
    inner = SM.stratified_holdout(outer.where("split = 'train'").drop("split"), "label", 0.25, "id", "42/validation")
    want = {r["id"]: "test" for r in outer.where("split = 'test'").collect()}
    want |= {r["id"]: "validation" if r["split"] == "test" else "train" for r in inner.collect()}
    assert both == want
