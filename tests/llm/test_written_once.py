"""What a stage writes once, and what it leaves behind."""

import contextlib
import glob
import io
import time

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from riskframe.llm import common, exact_dedup, mixing, ngram_join, tokens


def test_index_keys_are_made_once(spark, monkeypatch):
    made, real = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name, *a: made.append(name) or real(df, name, *a))
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words here now"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert made.count("index") == 1


def test_pipeline_frees_shuffles_between_stages(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before, seen = spark.conf.get(C.CLEANUP, None), []

    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get(C.CLEANUP))
        return docs.distinct()

    monkeypatch.setattr(C, "STAGES", [("one", stage), ("two", stage), ("last", lambda s, d, _: d)])
    assert C.run(spark, str(tmp_path)).count() == 2
    assert seen == ["true", "true"] and spark.conf.get(C.CLEANUP, None) == before


def test_index_holds_shared_keys_only(spark, monkeypatch):
    held, real = {}, ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name, *a: held.setdefault(name, real(df, name, *a)))
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a") + " x"), *((k, text(f"own{k}_")) for k in range(3, 9)), (9, text("own3_"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, **{k: k for k in range(3, 9)}, 9: 3}
    index = held["index"].collect()
    assert index and len({r["d1"] for r in index}) == 2
    assert all(len({r["d1"] for r in index if r["sig"] == s}) == 2 for s in {r["sig"] for r in index})


def test_words_are_hashed_whole():
    heads = [b"a", b"b" * 8, b"c" * 9, b"d" * 64, b"e" * 65, b"f" * 200]
    words = [h + t for h in heads for t in (b"", b"\0", b"z", b"\xc2\xa0", b"\x1c")]
    start, h = ngram_join.word_hashes(b" \t".join(words) + b"\n" + b"\x0b".join(words))
    assert len(start) == 2 * len(words) and len(set(h.tolist())) == len(words)
    assert h[:len(words)].tolist() == h[len(words):].tolist()
    # a text's set is the same whichever texts are hashed with it
    texts = [b" ".join(words), b"", b" ", b"one", b"A b  c", b"a B c d e", b" ".join(words[::-1])]
    alone = [next(ngram_join.token_sets(4, [t])).tolist() for t in texts]
    assert [s.tolist() for s in ngram_join.token_sets(4, texts)] == [s.tolist() for s in ngram_join.token_sets(4, texts, 1)] == alone
    assert [len(s) for s in alone] == [len(words) - 3, 0, 0, 1, 1, 2, len(words) - 3]


def test_known_words_outlast_a_full_memory(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 6)
    words = tokens.WordIds(P.path("word_bpe_49k.json"))
    whole = lambda t: np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    for text in ("red green pink", "red blue grey, white", "red " + "x" * 100, "a b c d e f g h red!"):
        assert words.of([text.encode()]) == [whole(text)]
        if "blue" in text:  # the memory was full here: what this text needs stays
            assert b"red" in words.known and b"green" not in words.known
        assert len(words.known) <= 6 and all(len(w) <= tokens.LONGEST for w in words.known)


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for d in disk.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}
    before, conf = held(), spark.conf.get(common.CLEANUP, None)
    rows = common.materialise(spark.range(1000, numPartitions=3).withColumn("k", F.col("id") % 7).groupBy("k").count(), "freed")
    for _ in range(100):  # files are removed in the background
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(common.CLEANUP, None) == conf
    assert rows.count() == 7


def test_sketches_of_compared_classes_are_moved(spark, monkeypatch):
    made, real = [], ngram_join.materialise

    def keep(df, name, *a):
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            df.explain()
        made.append((name, plan.getvalue()))
        return real(df, name, *a)

    monkeypatch.setattr(ngram_join, "materialise", keep)
    body = lambda k: [f"t{k}_{i}" for i in range(300)]
    texts = [" ".join(["other", *body(k)[1:]] if second else body(k)) for k in range(5) for second in (0, 1)]
    docs = spark.createDataFrame([*enumerate(texts), (50, texts[0] + " " + texts[2])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: i - i % 2 for i in range(10)} | {50: 50}
    plans = [plan for name, plan in made if name == "possible"]
    assert plans and all(plan.count("LeftSemi") == 2 for plan in plans)


def test_stages_write_no_row_twice(spark, monkeypatch):
    made, real = {}, common.materialise

    def keep(df, name, *a):
        made[name] = real(df, name, *a)
        return made[name]

    for module in (common, exact_dedup, mixing):
        monkeypatch.setattr(module, "materialise", keep)
    rows = [(1, "a b", "s"), (2, "ab", "s"), (None, "ab", "t"), *[(k, f"own{k}", "t") for k in range(3, 40)], (40, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = exact_dedup.drop_copies(docs)
    assert sorted((r.doc_id for r in left.collect())) == [1, *range(3, 41)] and left.columns == docs.columns
    assert made["rows"].count() == 3  # those with copies alone
    made.clear()
    mixed = mixing.mixed_documents(docs, weights=(1.0,), max_repeat=1)
    assert sorted(map(tuple, mixed.select("doc_id", "text").collect()), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    assert "rows" not in made and "mix" not in made and made["mixed"].count() == len(rows)
