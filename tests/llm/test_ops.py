"""Every operator against a brute-force version on a small nasty table: nulls,
empty and long texts, ties, repeated rows, clashing extra columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import (common, embedding_dedup, exact_dedup, license_scan, mixing, ngram_join, packing,
                           suffix_dedup, token_counts, tokens, toxicity, url_filter)

BASE = [f"w{i * 7919 % 1000}" for i in range(400)]
EXTRA = ["row", "size", "name", "u", "key", "words", "position", "start", "piece", "lo"]


def texts():
    near = list(BASE)
    near[5] = "other"
    far = BASE[:200] + [f"x{i}" for i in range(200)]
    return [" ".join(BASE), "\t".join(BASE) + "  ", " ".join(near), " ".join(far), None, "", "  \n", "one", "one two", "ONE Two",
            "tiny text here", "café <|endoftext|>  \n x  's don't　end ", "a" * 5000, "word " * 9000, " ".join(BASE)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", "b", None][i % 3], 7) for i, t in enumerate(texts())]
    rows.append(rows[3])  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA]).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def components(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(999, k) for k in range(400, 480)] + [(5, None), (7, 7)]
    got = dict(rows_of(common.connected_components(spark.createDataFrame(pairs, "u long, v long")), "node", "component"))
    real = [p for p in pairs if None not in p]
    low = components({x for p in real for x in p} | {5}, real)
    assert got == {k: low[k] for k in got} and set(low) == set(got)


def test_exact_dedup(docs, none):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in enumerate(texts())}
    every = [(i, texts()[i]) for i in [*norm, 3]]
    groups = defaultdict(list)
    for i, t in every:
        groups[norm[i]].append((-len(t or ""), i))
    want = sorted(((i, min(groups[norm[i]])[1], len(groups[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()) for i, _ in every), key=str)
    for key_bytes in (16, 1):  # one byte: keys clash, and bytes tell them apart
        got = exact_dedup.exact_groups(docs, key_bytes).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
        kept = [r.doc_id for r in got if r.kept]
        assert sorted(kept) == sorted({min(g)[1] for g in groups.values()})
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(kept)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


CLASH = ["_row", "_id", "_at", "_lap", "_position", "_gone", "_sha", "at", "of", "id", "last", "gone", "own"]


def test_stages_judge_rows(spark):
    # one id under other white space, ids that are missing, and names that helpers could have
    rows = [(7, "abc"), (7, "a b c"), (7, "a  b  c"), (None, "x y"), (None, "x  y"), (None, "z"), (7, "other"), (8, "other"), (8, "other"), (9, None), (3, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("s").alias("source"), *[F.lit(f"its {c}").alias(c) for c in CLASH])
    for d in (df, df.repartition(3)):
        left = exact_dedup.drop_copies(d)
        assert left.columns == df.columns
        got = left.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
            [(7, "a  b  c"), (None, "x  y"), (None, "z"), (7, "other"), (3, " ")], key=str)
        assert all(r[c] == f"its {c}" for r in got for c in CLASH)
    near, mixed = ngram_join.keep_one(df, words=5, percent=80), mixing.mixed_documents(df, weights=(1.0,), max_repeat=1)
    for out, want in ((near, 7), (mixed, len(rows))):
        got = out.collect()
        assert out.columns == df.columns and len(got) == want and all(r[c] == f"its {c}" for r in got for c in CLASH)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)


def test_mixed_words_are_linear():
    slow = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[^\W_][0-9@$!*|+]+[^\W\d_]\S*")
    r = random.Random(3)
    for _ in range(5000):
        t = "".join(r.choice("ab01!@+_. \té٣\u3000") for _ in range(14))
        assert toxicity.mixed_words(t) == slow.findall(t), repr(t)
    assert toxicity.mixed_words("a" + "0" * 1_000_000) == [] and len(toxicity.mixed_words("a0" * 500_000)) == 1


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("least", [4, 1])
def test_ngram_join(spark, docs, none, monkeypatch, least):
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", least)
    rng = np.random.default_rng(3)
    body = [f"v{i}" for i in range(120)]
    many = {100 + k: " ".join(w if rng.random() > 0.03 else f"n{k}" for w in body) for k in range(60)}
    own = dict(enumerate(texts())) | many
    both = docs.select("doc_id", "text").union(spark.createDataFrame(list(many.items()), "doc_id long, text string"))
    sets = {i: shingles(t, 4) for i, t in own.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    low = components(sets, linked)
    got = ngram_join.jaccard_components(both)
    assert rows_of(got.distinct(), "doc_id", "n_shingles", "component_id") == sorted(((i, len(sets[i]), low[i]) for i in sets), key=str)
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.jaccard_components(none).count() == 0


def test_keep_one_judges_rows(spark):
    near = lambda k: " ".join(w if j != k else "other" for j, w in enumerate(BASE))
    clean = " ".join(f"c{j}" for j in range(300))
    third = " ".join(f"t{j}" for j in range(300))
    rows = [(1, near(5)), (7, near(90)), (7, clean),  # one id: a near copy goes, a clean text stays
            (None, near(200)), (None, third), (None, third + " end"), (9, None), (None, ""), (None, "  "),
            (4, "a b c d e f g h"), (4, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit("clash"))
    for d in (df, df.repartition(3)):
        got = ngram_join.keep_one(d, words=5, percent=80)
        assert got.columns == df.columns
        left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        thirds = {(None, third), (None, third + " end")} & set(left)
        want = [(1, near(5)), (7, clean), (9, None), (None, ""), (None, "  "), (4, "a b c d e f g h"), *thirds]
        assert len(thirds) == 1 and left == sorted(want, key=str)


def test_signatures_meet():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 300))
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        x = np.sort(pool[:n])
        lost = ngram_join.missing(n, 85)
        y = np.sort(np.concatenate([rng.permutation(x)[int(rng.integers(0, lost + 1)):], pool[n:n + int(rng.integers(0, 2))]]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        for frequent in (np.empty(0, np.uint64), x, np.sort(rng.permutation(x)[:n // 2])):
            keys = [set(ngram_join.signatures(s, frequent, 85).tolist()) for s in (x, y)]
            assert keys[0] & keys[1]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(14)
    for n in (1, 3, 200, 3000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        for k in (0, 1, n // 10, n):
            a, b = pool[:n], pool[k:n + k // 2]
            places = int(np.bitwise_count((ngram_join.parity(a) ^ ngram_join.parity(b)).view(np.uint64)).sum())
            assert places <= len(np.setxor1d(a, b)) and (places - len(np.setxor1d(a, b))) % 2 == 0
    assert not ngram_join.parity(np.empty(0, np.uint64)).any()


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_token_counts(docs, none, monkeypatch, rows):
    monkeypatch.setattr(token_counts, "PACKED", rows)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(i, len((s or "").encode()), len(t.encode(s or "", add_special_tokens=False).ids)) for i, s in [*enumerate(texts()), (3, texts()[3])]]
    got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"))
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.collect())
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json")).count() == 0


def test_token_stretches():
    pre, word = tokens.PreTokens(P.path("byte_bpe_50k.json")), tokens.WordIds(P.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", " ", " ", "'s", "1", "́", "e", "É", "<|endoftext|>", "!", "\x1c", "　", "<|"]
    for _ in range(400):
        s = "".join(rng.choice(parts, 14))
        want = [x for x in pre.tokenizer.encode(s, add_special_tokens=False).tokens]
        units = [p for st in tokens.STRETCH.findall(s) for p in pre.of(st)]
        assert sum(tokens.piece_counts(pre.tokenizer, units)) == len(want), repr(s)
        assert np.frombuffer(word.ids(s.encode()), "<u4").tolist() == word.tokenizer.encode(s, add_special_tokens=False).ids, repr(s)


def test_packing(docs, none):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, s in [*enumerate(texts()), (3, texts()[3])]:
        ids = np.array(t.encode(s or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, a, len(ids[a:a + 256]), zlib.crc32(ids[a:a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    got = packing.pack_documents(docs, P.path("word_bpe_49k.json"), 256)
    assert rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    places = defaultdict(list)
    for r in got.collect():
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0


def test_minimum_slack():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 257, 3000)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.minimum_slack_plan(histogram, 256)
    used = defaultdict(int)
    for times, own in plan:
        assert times > 0 and sum(n * c for n, c in own) <= 256
        for n, c in own:
            used[n] += times * c
    assert dict(used) == histogram
    assert sum(t for t, _ in plan) <= 1.01 * lengths.sum() / 256 + 1
    # the first bin is the fullest there is around the longest length
    assert sum(n * c for n, c in packing.minimum_slack_plan({200: 1, 30: 1, 25: 1, 29: 1}, 256)[0][1]) == 255


def test_mixing(docs, none):
    m = mixing.mix(docs).toPandas()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in [*texts(), texts()[3]]]
    assert sorted(m["size"]) == sorted(size) and (m.taken <= 3 * m["size"]).all()
    for _, g in m.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1 and g.target.iloc[0] <= 3 * g["size"].sum() + 1e-6
        assert all(0 <= p <= 1 for x in g.positions for p in x)
    assert abs(m.groupby("source", dropna=False).target.first().sum() - sum(size)) < 1e-6
    assert m.sort_values("doc_id").taken.tolist() == mixing.mix(docs.repartition(7)).toPandas().sort_values("doc_id").taken.tolist()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect())
    assert abs(words - m.taken.sum()) <= 1
    order = [r.position for r in mixing.curriculum(docs).collect()]
    assert order == sorted(order)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixed_documents_keep_every_text(spark):
    # rows that agree in doc_id, source and number of words: null ids, and versions under one id
    rows = [(None, "a", f"none{k} x y") for k in range(6)] + [(1, "a", f"one{k} x y") for k in range(5)] + [(None, None, f"no source{k}") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one = {"weights": (1.0,), "max_repeat": 1}  # every source exactly once
    runs = [[(r.doc_id, r.source, r.text) for r in mixing.mixed_documents(d, **one).collect()] for d in (df, df.repartition(3))]
    assert sorted(runs[0], key=str) == sorted(runs[1], key=str) == sorted(rows, key=str)


def test_fill_levels(spark):
    rng = np.random.default_rng(8)
    for _ in range(5):
        sizes = [(f"s{k:02}", int(x)) for k, x in enumerate(rng.integers(0, 1000, 7) ** 2)]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        left, target = {s: (k % 3 + 1.0, 3.0 * n) for k, (s, n) in enumerate(sizes)}, {}
        rest = float(sum(n for _, n in sizes))
        while left:
            level = rest / sum(w for w, _ in left.values())
            over = {s for s, (w, full) in left.items() if w * level > full}
            for s in over or list(left):
                w, full = left.pop(s)
                target[s] = full if over else w * level
                rest -= full if over else 0
        assert got == pytest.approx(target)


def test_suffix_dedup(docs, none):
    for length, hot in ((100, 2000), (24, 2)):
        seen, want = set(), []
        for i, t in enumerate(texts()):
            b = (t or "").encode()
            gone = np.zeros(len(b) + 1, bool)
            for p in range(len(b) - length + 1):
                if b[p:p + length] in seen:
                    gone[p:p + length] = True
                seen.add(b[p:p + length])
            left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
            want.append((i, len(b), len(b) - len(left), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
        got = suffix_dedup.remove_repeats(docs, length, hot).distinct()
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(none).count() == 0
    alone = suffix_dedup.remove_repeats(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(alone) == 16 and any(r.n_removed for r in alone)


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0.0, 0.1, 0.3, 0.35)])
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)] + [(200, v[3].tolist(), 1), (3, v[3].tolist(), 0), (201, None, 0), (202, [0.0] * 16, 0),
                                                            (203, [float("nan")] * 16, 0), (204, [None] * 16, 0), (205, [], 0), (206, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1)).repartition(3)
    ids = [r[0] for r in rows[:122]]
    u = np.array([np.float32(r[1]).astype(float) for r in rows[:122]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    cos = (u @ u.T) >= 0.9
    low = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(cos), strict=True)])
    want = [(i, int(c.sum()) - 1, low[i], low[i] == i) for i, c in zip(ids, cos, strict=True)] + [(k, 0, k, True) for k in range(201, 207)]
    for tile in (4096, 20):
        assert rows_of(embedding_dedup.near_duplicates(df, tile=tile), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_urls(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    rows = [(0, "https://a.example.org/es/x", None), (1, "http://other.net/1", link.format("https://a.example.org/es/x")),
            (2, "http://www.other.net/1#top", ""), (3, "https://m.other.net/2/?utm_source=q", '<meta http-equiv="refresh" content="0; url=/1">'),
            (4, "http://x.COM/fr/a", link.format("http://other.org/k")), (5, "http://x.com/de/a?b#c", None), (6, None, None), (7, "no scheme", None),
            (8, "http://q.net/z", link.format("http://x.com/de/a?b")), (9, "http://q.net/z", link.format("http://x.com/fr/a")),
            (10, "http://EXAMPLE.org/en/12", None), (10, "http://EXAMPLE.org/en/12", None), (11, "http://notexample.org", None), (12, "http://e.com?x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert [got[k][3] for k in (1, 2, 3)] == ["block"] * 3 and got[1][2] is None
    assert got[4] == ("x.com", "/fr/a", "com/fr/", "allow") and got[5] == ("x.com", "/de/a", "com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][3] == got[9][3] == "allow"  # an explicit allow in the component wins
    assert got[10] == ("example.org", "/en/12", "example.org/en/1", "block") and got[11] == ("notexample.org", "", None, "allow")
    assert got[12][:2] == ("e.com", "")
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_urls_that_are_no_rows_decide_too(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    blocked, allowed = "http://x.com/de/{}", "http://x.com/fr/{}"
    rows = [(1, "http://a.net/1", link.format(blocked.format(1))), (2, "http://a.net/2", refresh.format(blocked.format(2))),
            (3, "http://a.net/3", link.format("http://b.net/3") + refresh.format(blocked.format(3))),  # the refresh counts beside a canonical link
            (4, "http://a.net/4", link.format("http://b.net/4") + link.format(blocked.format(4))),  # and so does a second tag
            (5, "http://a.net/5", link.format(blocked.format(5)) + refresh.format(allowed.format(5))),
            (6, "http://a.net/6", None), (7, "http://a.net/7", link.format("http://b.net/7")), (8, "http://a.net/8", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    hops = spark.createDataFrame([("http://a.net/6", blocked.format(6)), (blocked.format(6), "http://c.net/6"),  # a hop in the middle
                                  (blocked.format(8), "http://a.net/8"), (None, "http://a.net/7")], "from_url string, to_url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, redirects=hops).collect()}
    assert got == {k: (None, v) for k, v in zip(range(1, 9), ["block"] * 4 + ["allow", "block", "allow", "block"], strict=True)}


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.txt", "nothing here"), (3, "a/b/c/d/y.txt", None),
            (4, "a/b/LICENSE.md", "Some text\n\nReleased under the MIT\nLicense.\n"), (5, "z/q.txt", "words of the license plate"),
            (6, None, "Licensed under CC BY-NC 4.0."), (7, "z/own.txt", "x\n# SPDX-License-Identifier: GPL-3.0\ny"), (7, "z/own.txt", "x\n# SPDX-License-Identifier: GPL-3.0\ny"),
            (8, "ab/w.txt", "")]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumn("folder", F.lit("clash"))
    got = {r.id: (r.own_license, r.license, r.inherited_from) for r in license_scan.scan_licenses(df).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "MIT", "a/b"), 3: (None, "MIT", "a/b"), 4: ("MIT", "MIT", None), 5: (None, None, None),
                   6: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 7: ("GPL-3.0", "GPL-3.0", None), 8: (None, None, None)}
    assert license_scan.scan_licenses(df.where("false")).count() == 0


def test_license_files_with_whole_texts_and_titles(spark):
    held = license_scan.licence_texts()
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"} <= set(held)
    cases = []
    for name, (text,) in held.items():
        text = text.replace("<year> <holder>", "2021 Acme Inc.")
        cases += [(name, "LICENSE", text), (name, "COPYING.txt", " ".join(text.split()[12:])),  # one line, without the title
                  (name, "main.c", "\n".join(f"// {x}" for x in text.splitlines()) + "\nint main() {}\n")]
    titles = {"MIT License": "MIT", "Apache License\nVersion 2.0, January 2004": "Apache-2.0", "Mozilla Public License Version 2.0": "MPL-2.0",
              "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0", "Copyright (c) 2021 Acme Inc. All rights reserved.": "Proprietary",
              "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0", "the licence and the public": None, "License": None}
    cases += [(name, "LICENSE", title) for title, name in titles.items()]
    rows = [(k, f"d{k}/{file}", text) for k, (_, file, text) in enumerate(cases)]
    got = {r.id: r.own_license for r in license_scan.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {k: name for k, (name, _, _) in enumerate(cases)}


def test_license_scores_do_not_follow_the_corpus(spark):
    # 'licensed', 'all', 'rights' and 'reserved' are in every other row, 'copyright' in none
    notices = [(k, f"d{k}/x.txt", t) for k, t in enumerate(["All rights reserved.", "Released under the MIT License.", "all the license words", "Mit."])]
    fill = spark.range(100, 20_100).selectExpr("id", "concat('f', id, '.txt') AS path", "IF(id % 2 = 0, 'reserved licensed all rights here', 'plain words') AS text")
    few = spark.createDataFrame(notices, "id long, path string, text string")
    got = [{r.id: (r.own_license, r.own_score) for r in license_scan.scan_licenses(d).where("id < 100").collect()} for d in (few, few.union(fill))]
    assert got[0] == got[1] and [got[1][k][0] for k in range(4)] == ["Proprietary", "MIT", None, None]


def test_toxicity(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "You idiot! " * 5000)], "doc_id long, text string")
    got = toxicity.score_toxicity(d.select("doc_id", "text").union(odd), labels).toPandas()
    assert len(got) == d.count() + 3 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    seen = got.merge(labels.toPandas(), on="doc_id")
    seen = seen[seen.held_out]
    pos, neg = seen.score[seen.toxic == 1].to_numpy(), seen.score[seen.toxic == 0].to_numpy()
    assert ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) > 0.9 and (neg >= 0.7).mean() < 0.02
    by_id = got.set_index("doc_id").predicted
    assert by_id[-3] == 1 and by_id[-1] == by_id[-2] == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, labels.where("false")).collect()} == {0.0}


def test_capitals_are_a_share_of_letters_at_every_length():
    at = toxicity.FEATURES.index("capitals")
    rate = [toxicity.features_of("AB cd 12.. " * n, {}, 1, 1)[at] for n in (10, 18_000, 19_000, 40_000)]
    assert rate == [0.5] * 4


def test_pipeline(spark):
    import corpus_pipeline as C
    d = "/root/testdata/sf0.001"
    out = C.run(spark, d).toPandas()
    docs = common.table(spark, d, "documents")
    left = C.drop_copies(spark, C.drop_toxic(spark, docs, d), d)
    sets = {r.doc_id: shingles(r.text, 5) for r in left.collect()}
    low = components(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
                            and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert set(out.doc_id) <= {i for i in low if low[i] == i}
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.where("false"), d).count() == 0


def test_word_ids_are_the_librarys_on_odd_texts():
    rng = random.Random(3)
    parts = ["a", "B", "é", "É", "ß", "İ", "İ", "Á", "'s", "'T", "don't", ".", "!", "…", "÷", "×",
             "«", "3", "٣", "ſ", "K", "Σ", "ς", " ", "\n", "\x0b", "\x1c", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>",
             "<", "=", "̸", "`", "_", "x.", "x'.", "y!?", "ÿ,", "À)", "ñ$", "\0", "中", "\U0001f600", "​", ">", "ǅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    words = tokens.WordIds(P.path("word_bpe_49k.json"))
    want = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.of([t.encode() for t in texts]) == want
