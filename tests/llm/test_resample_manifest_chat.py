"""Importance resampling, Merkle manifest and chat windows against brute force: nulls,
empty and very long texts, ties, repeated rows, clashing extra columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import chat, importance, merkle

CLASH = ["id", "row", "part", "at", "score", "rank", "weight", "features", "tree", "size", "lo", "hi", "digest", "found", "bucket",
         "conv", "span", "place", "name", "tokens", "start", "end", "begins", "head", "body"]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


def words_of(t):
    t = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def features_of(t, longest=2):
    w = words_of(t)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


LONG = " ".join(f"Wort{i % 997}é" for i in range(60_000))  # 0.5 MB, and one word of 300 KB below
TEXTS = [None, "", " \n..", "one", "One two", "ÉTÉ été x1,y2  z", LONG, "q" * 300_000, "a " * 30, "b\x01c \x0112 " + "k" * 300, "日本 語a bé",
         " ".join(f"s{i}" for i in range(40)), " ".join(f"s{i}" for i in range(40)), "target words here " * 9]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_scan_composes_ngrams(longest):
    got = importance.ngram_buckets([(t or "").encode() for t in TEXTS], longest=longest)
    for t, (n, found) in zip(TEXTS, got, strict=True):
        assert n == len(words_of(t))
        assert sorted(found.tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features_of(t, longest))


def test_shift_is_concatenation():
    rng = random.Random(5)
    for _ in range(200):
        a, b = rng.randbytes(rng.randrange(9)), rng.randbytes(rng.randrange(300))
        got = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0] ^ np.uint32(zlib.crc32(b))
        assert int(got) == zlib.crc32(a + b)


def brute_resample(rows, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = Counter(bucket(f) for _, t in rows for f in features_of(t))
    want = Counter(bucket(f) for t in target for f in features_of(t))
    big, small = sum(own.values()), sum(want.values())
    out = []
    for i, t in rows:
        g = [math.floor(1000 * math.log((want[b] + 1.0) * (big + 10_000) / ((own[b] + 1.0) * (small + 10_000)))) for b in map(bucket, features_of(t))]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(t))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent,least", [(25, 20), (60, 0)])
def test_resample(spark, percent, least):
    rows = list(enumerate(TEXTS)) + [(k, f"filler {k} " + "target words here " * (k % 7) + "more text " * 12) for k in range(100, 160)]
    rows += [(3, "one"), (None, None), (None, "target words here " * 8)] + [(777, "copy of a row " * 9)] * 30
    target = ["target words here and more", None, "", "Target!"]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    bench = clashing(spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"))
    got = importance.resample(docs, bench, percent=percent, least_words=least).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(rows, target, percent, least)


def test_resample_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(docs.where("false"), docs).count() == 0
    assert [r.n_features for r in importance.resample(docs, docs.where("false")).collect()] == [5]


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def brute_tree(leaves, arity):
    """(root, [siblings of every leaf, level by level])."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // arity * arity
            run = level[first:first + arity]
            proofs[k].append(("".join(run[:i - first]), "".join(run[i - first + 1:])))
            at[k] = i // arity
        level = [h(*level[j:j + arity]) for j in range(0, len(level), arity)]
    return level[0], proofs


def brute_manifest(rows, arity):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for r in rows:
        leaf = h(*map(said, r))
        flat = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf, h(*map(said, (*r[:4], r[4].replace("\n", "") if flat else r[4])))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort()
        built[s] = brute_tree([x[2] for x in trees[s]], arity)
    root, tops = brute_tree([built[s][0] for s in names], arity)
    out = []
    for s, top in zip(names, tops, strict=True):
        for (known, i, leaf, found), own in zip(trees[s], built[s][1], strict=True):
            steps, back = [*own, *top], found
            for a, b in steps:
                back = h(a, back, b)
            out.append((i if known else None, leaf, built[s][0], root, h("".join(a + b for a, b in steps)), back, back == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height,arity", [(6, 3), (1, 3), (2, 2)])
def test_manifest(spark, height, arity):  # low bands: many joins between few rows
    rng = random.Random(height)
    rows = [(k, rng.choice(["hot", "hot", None, "", "é", "z", "solo" if k == 7 else "b"]), rng.choice(["de", None]), rng.choice([None, 5]),
             rng.choice([None, "", "a\nb", "line\n" * 3, "plain"])) for k in range(260)]
    rows += [(5, "hot", "de", 1, "again\n")] * 3 + [(None, "hot", None, None, None), (None, None, None, None, "x\ny"), (900, "only", "x", 1, "y\n" * 200_000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).repartition(4)
    m = merkle.manifest(docs, arity=arity, height=height, altered={"text": merkle.without_line_breaks(F.col("doc_id"), F.col("text"))})
    back = merkle.folded(F.col("found"), F.col("left"), F.col("right"))
    got = m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("left"), F.col("right")).alias("proof"), back.alias("back"), (back == F.col("root")).alias("ok"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows, arity)


def test_manifest_small(spark):
    one = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    r, = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == h("1:1", "-", "-", "-", "-") and r.left == r.right == [] and r.source is None
    assert merkle.manifest(one.where("false")).count() == 0


MEAN = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "[INST", "<s><s>", "[/INST]\n</s", "", None, "a[INST]b<s>\\n", "[[INST]]", "</s></s>", "x\\<s>"]


def conversations():
    rng = random.Random(2)
    word = lambda n: " ".join(rng.choice(["été", "go", "<s>", "words"]) for _ in range(n))
    rows = []
    for c in range(30):
        turns = [("system", word(rng.randrange(9)))] * rng.randrange(2)
        turns += [(rng.choice(["user", "assistant", "tool", None, "</s>"]), rng.choice([word(rng.randrange(1, 40)), rng.choice(MEAN)])) for _ in range(rng.randrange(9))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(500, k, ["user", "assistant"][k % 2], word(12)) for k in range(400)]  # one conversation with most rows
    rows += [(501, k, "assistant", m) for k, m in enumerate(MEAN)] + [(502, 3, "assistant", "same")] * 20
    rows += [(None, 1, "user", "no id"), (None, None, "assistant", "no turn"), (503, None, "system", "first"), (504, 0, "assistant", "long " * 200_000), (504, 1, "user", "after")]
    return rows


@pytest.mark.parametrize("budget,history", [(60, 20), (1024, 256), (30, 0), (1, 1)])
def test_chat_windows(spark, budget, history):
    rows = conversations()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(4)
    w = chat.windows(chat.with_control_case(df), budget, history).persist()
    rows = rows + [(-1, 0, "user", MEAN[0]), (-1, 1, "assistant", MEAN[0])]
    by = defaultdict(list)
    for c, t, r, x in rows:
        x, r = x or "", r or ""
        by[c].append((t is not None, t or 0, r, hashlib.md5(x.encode()).hexdigest(), x))
    want = []
    for c, turns in by.items():
        turns.sort()
        target = [t[4] for t in turns if t[2] == "assistant"]
        want.append((c, len(turns), h("".join(f"{t[2]}\n{t[4]}\n" for t in turns)), sum(map(len, target)), h(*target)))
    got = chat.read_back(w).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    tokens = lambda t: math.ceil((len(t[2].encode()) + len(t[4].encode())) / 4) + 4
    seen = defaultdict(list)
    for r in w.orderBy("conv_id", "window").collect():
        turns = by[r.conv_id]
        assert r.formatted.startswith("<s>") and r.formatted.count("</s>") == r.n_turns == r.formatted.count("[INST]") == r.formatted.count("[/INST]")
        done = len(seen[r.conv_id])
        new = turns[done:done + r.n_turns - r.repeated]
        seen[r.conv_id] += new
        system = done > 0 and turns[0][2] == "system"
        past = turns[done - (r.repeated - system):done] if r.repeated - system else []
        assert r.n_tokens == sum(map(tokens, new + past + turns[:1] * system))
        assert sum(map(tokens, past)) <= history and (not system or r.formatted.startswith("<s>[INST]system[/INST]"))
        head = tokens(turns[0]) if turns[0][2] == "system" else 0
        assert r.over_budget == (r.n_tokens > budget) and (not r.over_budget or len(new) == 1 or budget < history + head + 10)
    assert all(len(seen[c]) == len(by[c]) for c in by)


def test_chat_empty_and_escapes(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(none).count() == 0 and chat.read_back(chat.windows(none)).count() == 0
    rng = random.Random(8)
    texts = ["".join(rng.choices(["<", "s", ">", "/", "[", "]", "INST", "\\", "\n", "é"], k=rng.randrange(14))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r.t == r.u and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))
