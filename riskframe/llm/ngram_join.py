"""N-gram Jaccard join by token-combination prefixes.

The tokens of a document are its distinct word n-grams. Under one global order,
rare tokens before frequent ones and these by the power of two of their count,
two similar sets must meet in their prefixes:
in one rare token, or in two frequent tokens of one group. So prefixes are
extended over frequent tokens and indexed by pairs of them, while rare tokens are
indexed alone. Sets that meet are verified exactly.

Only components are asked for, so a group of sets under one index key is compared
with pivots of other components, never pair by pair within a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, rows_with_number, small, spread, text_batches

WORDS, SIMILARITY = 4, 85
#: Frequent tokens: at most this many (8 bytes each), the most frequent ones, each
#: seen at least FREQUENT_FROM times. Tokens beyond it are indexed alone, so the
#: choice moves work and no result, and so does the order of the frequent ones.
FREQUENT, FREQUENT_FROM = 1_000_000, 4
#: Prefix tokens per pair group; pivots of the first round with several.
PER_GROUP, PIVOTS = 2, 8
#: Keys grouped together in a task, about.
KEYS = 250_000
#: Bits of a set's parity, in whole 64-bit numbers.
PARITY = 512
BITS = [f"b{k}" for k in range(PARITY // 64)]
_MIX = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first bytes of eight; words up to this many bytes are hashed side by side.
_FIRST, LONG = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 64


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of a text, cut at [\x20\x09-\x0D]: eight bytes
    of all words at a time; words of more than LONG bytes are hashed one by one."""
    data = text + bytes(8)
    b = np.frombuffer(data, np.uint8)[:len(text)]
    word = (b != 32) & (b - np.uint8(9) > 4)
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(text) + 1,), "<u8", data, strides=(1,))
    h = _stir((eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _MIX[20])
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest) and done < LONG:
        more = eight[start[rest] + done] & _FIRST[np.minimum(size[rest] - done, 8)]
        h[rest] = _stir(h[rest] * _MIX[21] + more)
        done += 8
        rest = rest[size[rest] > done]
    for i in rest.tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i]:start[i] + size[i]])
    return start, h


def _chunks(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def token_sets(words: int, texts: list[bytes], limit: int = 1 << 18) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit n-gram tokens of each text; words of about ``limit`` bytes
    of texts are hashed together."""
    for part in _chunks(texts, limit):
        # bytes.lower() lower-cases A-Z alone
        start, w = word_hashes(b"\n".join(part).lower())
        cut = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in part])).tolist()
        full = np.full(max(0, len(w) - words + 1), words, np.uint64)
        for j in range(words):
            full += w[j:len(full) + j] * _MIX[j]
        full = _stir(full)
        for lo, hi in zip(cut, cut[1:]):
            k = hi - lo
            if k >= words:
                h = full[lo:hi - words + 1].copy()
            elif k:
                h = _stir(np.array([k], np.uint64) + (w[lo:hi] * _MIX[:k]).sum(dtype=np.uint64))
            else:
                h = w[:0]
            h.sort()
            yield h[np.concatenate(([True], h[1:] != h[:-1]))] if k else h


def missing(n: int, percent: int) -> int:
    """Tokens of a set of n that a similar set can lack."""
    return n - -(-percent * n // 100)


def level_of(n: int, percent: int) -> int:
    """Sizes of similar sets are at most one level apart (the base is a little
    wider than the ratio, against rounding)."""
    return int(math.log(n) / -math.log(percent / 100 - 1e-4))


def index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int, powers: np.ndarray | None = None) -> tuple[np.ndarray, int | None, int]:
    """(keys, rare, first): index keys of a sorted token set, rare tokens before
    combinations; the number of its rare tokens if all of them are keys; and the
    number of keys before those of the next level. Similar sets that differ have a
    key in common, sets of one level even without the next one's keys. powers orders
    the frequent tokens, the least frequent first, ties by value.

    A set lacks at most ``missing`` of its tokens in a similar one, so of a
    prefix with more than that many rare tokens, one is shared. Else the prefix
    goes on over frequent tokens, dealt to groups by their value: sharing at most
    one token of each group leaves fewer than (prefix less one for each group
    met), so once that passes ``missing``, some group shares two. The number of
    groups belongs to a size level; a set is indexed under its own level and the
    next, and similar sets have a level in common.
    """
    n = len(tokens)
    need = missing(n, percent) + 1
    look, rare, often = 2 * need, tokens, tokens[:0]
    while len(frequent):
        part = tokens[:look]
        at = np.searchsorted(frequent, part)
        common = frequent[np.minimum(at, len(frequent) - 1)] == part
        rare, often = part[~common], part[common]
        if len(rare) >= need or look >= n:
            if powers is not None:
                often = often[np.argsort(powers[at[common]], kind="stable")]
            break
        look = n
    keys = [rare[:need]]
    if len(rare) < need and n > 1:
        own = level_of(n, percent)
        for level in (own, own + 1):
            size = (percent / 100 - 1e-4) ** -level
            groups = max(1, int(size * (1 - percent / 100) / PER_GROUP))
            group = _stir(often + np.uint64(level)) % np.uint64(groups)
            seen = np.zeros(len(often), np.int64)
            seen[np.unique(group, return_index=True)[1]] = 1
            gain = np.arange(1, len(often) + 1) - np.cumsum(seen) + len(rare)
            stop = int(np.searchsorted(gain, need)) + 1
            order = np.argsort(group[:stop], kind="stable")
            t, g = often[:stop][order], group[:stop][order]
            for apart in range(1, len(g)):  # all pairs of a group: neighbours, then those one further apart
                pair = np.flatnonzero(g[apart:] == g[:-apart])
                if not len(pair):
                    break
                keys.append(_stir(t[pair] * _MIX[10] + t[pair + apart] * _MIX[11] + np.uint64(level)))
            if level == own:
                first = sum(map(len, keys))
    else:
        first = len(keys[0])
    return np.concatenate(keys), len(rare) if len(rare) < need else None, first


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    return index_keys(tokens, frequent, percent)[0]


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each value of a token's last bits whether an odd number of tokens has it.
    Parities of two sets differ in no more places than there are tokens in one set
    alone, as each of these turns one place over."""
    odd = np.bincount((tokens & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _describe(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per slice: doc_id, size, 128-bit name and parity of each set, and the tokens
    that several documents of the slice hold, with their number. A token in more
    documents than there are slices cannot stay below two in all of them."""
    for (ids,), texts in text_batches(batches, "doc_id"):
        sets = list(token_sets(words, texts))
        names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        pairs = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
        token, count = np.unique(np.concatenate(list(dict(zip(names, sets, strict=True)).values())), return_counts=True)
        own = count > 1
        odd = np.array([parity(s) for s in sets]).reshape(-1, len(BITS))
        cols = [ids, [len(s) for s in sets], pairs[:, 0], pairs[:, 1], token[own].view(np.int64), count[own].astype(np.int64), *odd.T]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(pa.int64())) for c in cols],
                                         ["doc_id", "n", "d1", "d2", "token", "times", *BITS])


def _index(words: int, frequent, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index keys of a slice by bucket of the key, a row each: keys (sigs), first halves
    of their sets' names (d1s), and marks: 4 * (1 + number of the set's rare tokens
    where all are keys, else 0) + 2 * (the key is one of these) + (it is of the next
    level). Eight-byte numbers side by side, as rows of their own take twice the space."""
    for _, texts in text_batches(batches):
        sig, name, mark, done = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], set()
        for s in token_sets(words, texts):
            d = xxhash.xxh3_128_digest(s.tobytes())
            if d not in done and len(s):
                done.add(d)
                keys, alone, first = index_keys(s, *frequent.value)
                m = np.zeros(len(keys), np.int32)
                if alone is not None:
                    m += 4 * (alone + 1)
                    m[:alone] += 2
                m[first:] += 1
                sig.append(keys)
                name.append(np.full(len(keys), np.frombuffer(d[:8], "<i8")[0]))
                mark.append(m)
        sigs = np.concatenate(sig)
        bucket = (sigs % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        own, start = np.unique(bucket[order], return_index=True)
        start = np.append(start, len(order))
        cols = [pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((start * c.itemsize).astype(np.int32)), pa.py_buffer(c[order])])
                for c in (sigs, np.concatenate(name), np.concatenate(mark))]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *cols], ["bucket", "sigs", "d1s", "marks"])


def _met(bucket: pa.Table) -> pa.Table:
    """Distinct rows (sig, d1, rare, single, later) of the keys that several sets have."""
    sig, d1, mark = (np.frombuffer(b"".join(bucket.column(c).to_pylist()), kind)
                     for c, kind in (("sigs", np.uint64), ("d1s", np.int64), ("marks", np.int32)))
    order = np.argsort(sig)
    sig, d1, mark = sig[order], d1[order], mark[order]
    start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    several = np.minimum.reduceat(d1, start) != np.maximum.reduceat(d1, start)
    held = np.repeat(several, np.diff(start, append=len(sig)))
    sig, d1, mark = sig[held], d1[held], mark[held]
    order = np.lexsort((mark, d1, sig))
    sig, d1, mark = sig[order], d1[order], mark[order]
    first = np.ones(len(sig), bool)
    first[1:] = (sig[1:] != sig[:-1]) | (d1[1:] != d1[:-1]) | (mark[1:] != mark[:-1])
    sig, d1, mark = sig[first], d1[first], mark[first]
    rare = (mark >> 2).astype(np.int64) - 1
    cols = [sig.view(np.int64), d1, pa.array(rare, mask=rare < 0), mark & 2 > 0, mark & 1 > 0]
    return pa.table([pa.array(c) for c in cols], ["sig", "d1", "rare", "single", "later"])


def _named(words: int, batches: Iterator[pa.RecordBatch], make, kind: str) -> Iterator[pa.RecordBatch]:
    """cid and make(tokens) of the rows whose set has the name that cid stands for."""
    for (cids, firsts, seconds), texts in text_batches(batches, "cid", "d1", "d2"):
        out = [(c, make(s)) for c, a, b, s in zip(cids, firsts, seconds, token_sets(words, texts), strict=True)
               if xxhash.xxh3_128_digest(s.tobytes()) == np.array([a, b], "<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["cid", kind])


def sketch(tokens: np.ndarray) -> bytes:
    """The first 20 bits of each token, as compressed differences."""
    step = np.diff(tokens >> np.uint64(44), prepend=np.uint64(0)).astype("<u4")
    return zstandard.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _read_sketch(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy()
    return np.cumsum(raw.view("<u4").ravel().astype(np.uint64))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many of a are in b (sorted)."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _similar(percent: int, n: int, m: int, both: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _possible(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches leave it possible: shared tokens share their first bits."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            a, b = _read_sketch(x), _read_sketch(y)
            good.append(_similar(percent, len(a), len(b), min(_common(a, b), _common(b, a))))
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _verify(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for pair in batch.column("sets").to_pylist():
            a, b = (np.frombuffer(x, np.uint64) for x in pair)
            good.append(_similar(percent, len(a), len(b), _common(a, b)))
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def frequent_tokens(slices: DataFrame, most: int = FREQUENT, least: int = FREQUENT_FROM) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, powers): a sorted array of at most ``most`` tokens, those counted most
    often over all documents, and the power of two of each one's count. Whole powers
    are taken or left."""
    pairs = slices.select(F.explode(F.arrays_zip("token", "times")).alias("x")).select("x.token", "x.times")
    counts = materialise(pairs.groupBy("token").agg(F.sum("times").alias("n")).where(F.col("n") >= least)
                         .select("token", F.floor(F.log2("n")).cast("int").alias("p")), "token_counts")
    held, floor = 0, None
    for row in counts.groupBy("p").count().orderBy(F.desc("p")).collect():
        if held + row["count"] > most:
            break
        held, floor = held + row["count"], row["p"]
    if floor is None:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    rows = counts.where(F.col("p") >= floor).select("token", "p").toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("p").to_numpy().astype(np.int8)[order]


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    A document's set has its distinct n-grams of ``words`` words, A-Z in lower
    case; with fewer words, the whole sequence as one; without words or text it
    is empty and linked with nothing. Two documents link when 100 * intersection
    >= percent * union. component_id is the smallest doc_id reachable. Equal sets
    are one class, whatever their number; repeated rows are equal sets. Rows
    without a doc_id are linked with nothing and have no component_id. Sets are
    compared by 64-bit tokens.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = ", ".join(f"{c} array<long>" for c in ("doc_id", "n", "d1", "d2", "token", "times", *BITS))
    slices = materialise(src.mapInArrow(partial(_describe, words), parts), "slices")
    info = materialise(slices.select(F.explode(F.arrays_zip("doc_id", "n", "d1", "d2", *BITS)).alias("x")).select("x.*")
                       .withColumn("row", F.monotonically_increasing_id()), "sets")
    src = src.where("doc_id IS NOT NULL")
    classes = materialise(info.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2")
                          .agg(F.min("row").alias("cid"), F.min("doc_id").alias("least"), F.max("n").alias("n"),
                               *[F.max(b).alias(b) for b in BITS]), "classes")
    tokens, powers = frequent_tokens(slices)
    frequent = spark.sparkContext.broadcast((tokens, percent, powers))
    # a set has about as many keys as it may lack tokens; each bucket is grouped in one task's memory
    held = classes.agg(F.sum("n")).first()[0] or 0
    buckets = spread(held * (100 - percent) // 100, KEYS, 32)
    index = (src.select("text").mapInArrow(partial(_index, words, frequent, buckets), "bucket int, sigs binary, d1s binary, marks binary")
             .groupBy("bucket").applyInArrow(_met, "sig long, d1 long, rare long, single boolean, later boolean"))
    met = materialise(index, "index")
    # where all rare tokens of a set are keys, those that no other set has as a key are its own
    own = met.groupBy("d1").agg((F.max("rare") - F.count_if("single")).alias("own"))
    known = classes.join(own, "d1").select("d1", "cid", "n", (F.col("n") - F.col("own")).alias("most"))
    met = materialise(met.join(known, "d1").select("sig", "later", "cid", "n", "most"), "met")
    parts = _linked(src, classes, met, words, percent)
    named = classes.join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    owner = named.select("d1", "d2", "component").join(least, "component").select("d1", "d2", "component_id")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return info.join(owner, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component of near copies; all columns stay. The row
    with the smallest doc_id stays (null last), then the one whose text has the
    smallest md5. Input columns may have any names. Components run over rows: rows without a doc_id or with one that
    others have too are judged by their own texts. Rows without words stay."""
    rows = rows_with_number(docs, "doc_id", "text", name="rows")
    parts = materialise(jaccard_components(rows.select(F.col("at").alias("doc_id"), "text"), **options)
                        .select(F.col("doc_id").alias("own"), "component_id"), "row_parts")
    # most components are one row: only the others need an order
    several = materialise(parts.where("own <> component_id").select("component_id").distinct(), "several")
    met = parts.join(small(several), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("i"), F.md5("text").alias("t"), F.col("at").alias("r"))
    told = materialise(rows.join(met, F.col("at") == F.col("own")).select("component_id", order.alias("o")), "told")
    best = told.groupBy("component_id").agg(F.min("o").alias("best"))
    gone = materialise(told.join(best, "component_id").where(F.col("o.r") != F.col("best.r")).select(F.col("o.r").alias("gone")), "gone")
    return rows.select("row", "at").join(small(gone), F.col("at") == F.col("gone"), "left_anti").select("row.*")


def _linked(src: DataFrame, classes: DataFrame, met: DataFrame, words: int, percent: int) -> DataFrame:
    """(cid, component) of the classes that verified links connect, from the index
    rows met (sig, later, cid, n, most). A pair of classes under a common key is left
    out only when the two are in one component already, compared and found unlike,
    both under a key of the next level (similar ones meet under their own), or too
    unlike by their numbers: by their sizes, because their parities differ in more
    places than similar sets have tokens apart, or because two sets with all rare tokens
    indexed share at most ``most`` tokens, all but those that no other set has. These
    are conditions of the join itself, so unlike pairs under a key make no rows.

    Pairs are compared by sketches of some 1.5 bytes a token, made once; what
    those leave possible, by whole token sets made anew from the texts.
    """
    both = F.least("n", "m", "most", "most_m")  # nulls are skipped, and so is a bound of one set alone
    both = F.when(F.col("most").isNotNull() & F.col("most_m").isNotNull(), both).otherwise(F.least("n", "m"))
    like = both * 100 >= (F.col("n") + F.col("m") - both) * percent
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_v"))) for b in BITS), F.lit(0))
    # at most (n + m - apart) / 2 tokens are shared
    near = (F.col("n") + F.col("m") - apart) * (100 + percent) >= (F.col("n") + F.col("m")) * (2 * percent)
    texts_of = lambda some: (src.join(small(some), src["doc_id"] == some["least"])
                             .select(*[c for c in some.columns if c != "least"], "text"))
    wanted = materialise(met.select("cid").distinct().join(classes, "cid").select("cid", "least", "d1", "d2"), "wanted")
    sketches = materialise(texts_of(wanted).mapInArrow(partial(_named, words, make=sketch, kind="sketch"), "cid long, sketch binary"), "sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        # later rounds compare few classes: the sketches of the others are not moved
        ends = pairs.select(F.explode(F.array("u", "v")).alias("cid"))
        some = sketches.join(F.broadcast(ends) if pairs.count() <= 250_000 else ends, "cid", "left_semi")
        x = some.select(F.col("cid").alias("u"), F.col("sketch").alias("x"))
        y = some.select(F.col("cid").alias("v"), F.col("sketch").alias("y"))
        left = materialise(pairs.select("u", "v").join(x, "u").join(y, "v").mapInArrow(partial(_possible, percent), "u long, v long").distinct(), "possible")
        ends = left.select(F.explode(F.array("u", "v")).alias("cid"), "u", "v")
        some = materialise(ends.select("cid").distinct().join(wanted, "cid"), "ends")
        sets = texts_of(some).mapInArrow(partial(_named, words, make=np.ndarray.tobytes, kind="tokens"), "cid long, tokens binary")
        both = sets.join(ends, "cid").groupBy("u", "v").agg(F.collect_set("tokens").alias("sets"))
        return materialise(both.mapInArrow(partial(_verify, percent), "u long, v long"), "links")

    def components(edges: DataFrame) -> DataFrame:
        return materialise(connected_components(edges).select(F.col("node").alias("cid"), "component"), "parts")

    # first every class with the smallest class it meets: as many pairs as classes
    first = met.groupBy("sig").agg(F.min_by(F.struct(F.col("cid").alias("v"), F.col("n").alias("m"), F.col("most").alias("most_m")), "cid").alias("f"))
    pairs = met.join(first, "sig").select("cid", "n", "most", "f.*").where("cid <> v").where(like)
    pairs = materialise(pairs.groupBy("cid").agg(F.min("v").alias("v")).select(F.col("cid").alias("u"), "v"), "pairs")
    edges, tried, pivots = verified(pairs), pairs, PIVOTS
    parts, rest, bits = components(edges), met, []
    while True:
        now = rest.join(parts, "cid", "left").select("sig", "later", "cid", "n", "most", *bits, F.coalesce("component", "cid").alias("c"))
        open_ = now.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig", "size")
        # one in a power of two of the classes, the same ones under every key: near
        # copies meet under many keys, and few of them should be pivots in all
        share = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("size") / pivots)))).cast("long")
        rest = now.join(open_, "sig").withColumn("pivot", F.pmod(F.xxhash64("cid"), share) == 0)
        if not bits:  # parities take most of a row: only rows of open keys get them
            rest, bits = rest.join(classes.select("cid", *BITS), "cid"), BITS
        rest = materialise(rest, "open")
        if rest.isEmpty():
            return parts
        p = rest.where("pivot").select("sig", F.col("later").alias("later_v"), F.col("cid").alias("v"), F.col("n").alias("m"), F.col("most").alias("most_m"), F.col("c").alias("d"),
                                       *[F.col(b).alias(f"{b}_v") for b in BITS])
        pairs = (rest.join(p, "sig").where("c <> d AND NOT (later AND later_v) AND (NOT pivot OR cid > v)").where(like & near)
                 .select(F.greatest("cid", "v").alias("u"), F.least("cid", "v").alias("v")).distinct())
        pairs = materialise(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        links = verified(pairs)
        if not links.isEmpty():  # earlier components stand for the links they came from
            parts = components(links.union(parts.select(F.col("cid").alias("u"), F.col("component").alias("v"))))
        tried = tried.union(pairs)
        rest = rest.where("NOT pivot").select("sig", "later", "cid", "n", "most", *BITS)  # a pivot has met the whole group
        pivots *= 8
