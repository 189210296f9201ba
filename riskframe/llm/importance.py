"""Importance resampling towards a target distribution on hashed word n-grams.

The words of a slice of texts form an Aho-Corasick dictionary, each bounded by
delimiters and carrying a payload: its CRC, the CRC with a space behind it and its
length. One scan of the normalised text emits payloads in order; the CRC of two
adjacent words is composed from their payloads (the first one shifted by the
second one's length), so no n-gram is ever built as a string. Bucket counts of the
corpus and of the target give a gain for every bucket, and the mean gain plus
Gumbel noise orders the documents: the highest are a draw without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered, slices

BUCKETS = 10_000
#: Bytes of text whose distinct words form one dictionary; bounds a task's memory.
SLICE = 4 << 20
#: Longer words stand in the text as a short mark of their own, so that the
#: dictionary never gets a node for each of their bytes.
LONG_WORD = 256

#: Bytes of words ([0-9a-z] and all of UTF-8 past ASCII) stay, A-Z go to a-z, the rest to a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LONG = re.compile(rb"[^ ]{%d,}" % (LONG_WORD + 1))
_POLY = 0xEDB88320


def _byte_step() -> np.ndarray:
    """What a zero byte makes of each bit of a CRC register."""
    image = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (_POLY if c & 1 else 0)
        image.append(c)
    return np.array(image, np.uint32)


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


_STEPS = [_byte_step()]  # _STEPS[k]: a shift by 2**k bytes


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs moved by ``by`` bytes each: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    out = crc.astype(np.uint32)
    k = 0
    while (by >> k).any():
        if len(_STEPS) <= k:
            _STEPS.append(_apply(_STEPS[-1], _STEPS[-1]))
        own = (by >> k & 1).astype(bool)
        out[own] = _apply(_STEPS[k], out[own])
        k += 1
    return out


class Dictionary:
    """Delimiter-bounded words of some normalised texts with their payloads."""

    def __init__(self, texts: list[bytes]):
        self.marks: dict[bytes, bytes] = {}
        self.texts = [_LONG.sub(self._mark, t) if len(t) > LONG_WORD else t for t in texts]
        words = set()
        for t in self.texts:
            words.update(t.split())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        whole = {mark: word for word, mark in self.marks.items()}
        plain, spaced, lengths = [], [], []
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
            w = whole.get(w, w)
            crc = zlib.crc32(w)
            plain.append(crc)
            spaced.append(zlib.crc32(b" ", crc))
            lengths.append(len(w))
        if words:
            self.automaton.make_automaton()
        self.plain, self.spaced, self.lengths = np.array(plain, np.uint32), np.array(spaced, np.uint32), np.array(lengths, np.int64)

    def _mark(self, found: re.Match) -> bytes:
        # byte 1 is a delimiter, so no word of a text looks like a mark
        return self.marks.setdefault(found[0], b"\x01%d" % len(self.marks))

    def scan(self) -> list[np.ndarray]:
        """The payload numbers of every text's words, in order."""
        if not len(self.plain):
            return [np.empty(0, np.int64) for _ in self.texts]
        return [np.array([v for _, v in self.automaton.iter(f" {t.decode('latin-1')} ")], np.int64) for t in self.texts]


def ngram_buckets(texts: list[bytes], buckets: int = BUCKETS, longest: int = 2) -> list[tuple[int, np.ndarray]]:
    """(words, buckets of all runs of 1 to ``longest`` words) for every UTF-8 text."""
    if not texts:
        return []
    d = Dictionary([t.translate(_NORMAL) for t in texts])
    scanned = d.scan()
    counts = np.array([len(s) for s in scanned], np.int64)
    own = np.concatenate([*scanned, np.empty(0, np.int64)])
    text_of = np.repeat(np.arange(len(scanned)), counts)
    word = d.plain[own] if len(own) else np.empty(0, np.uint32)
    runs, ends = [word], [text_of]
    crc = word
    for n in range(2, longest + 1):  # a run of n: the run of n - 1 that starts a word earlier, a space, a word
        before = d.spaced[own[:-1]] if n == 2 else shifted(crc[:-1], np.ones(max(0, len(crc) - 1), np.int64)) ^ np.uint32(zlib.crc32(b" "))
        crc = np.concatenate([np.zeros(min(1, len(own)), np.uint32), shifted(before, d.lengths[own[1:]]) ^ word[1:]])
        inside = np.zeros(len(own), bool)
        inside[n - 1:] = text_of[n - 1:] == text_of[:len(text_of) - n + 1]
        runs.append(crc[inside])
        ends.append(text_of[inside])
    every, owner = np.concatenate(runs) % np.uint32(buckets), np.concatenate(ends)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(texts)))
    return list(zip(counts.tolist(), np.split(every[order], cuts), strict=True))


def features(docs: DataFrame, id_col: str, buckets: int = BUCKETS, longest: int = 2) -> DataFrame:
    """id, n_words, features (the buckets as little-endian integers of 16 bits, or of
    32 where there are more buckets than 65,536) for every row; one scan of each text."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, SLICE):
            found = ngram_buckets(texts, buckets, longest)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([f.astype(kind).tobytes() for _, f in found], pa.binary())], ["id", "n_words", "features"])
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(scan, "id long, n_words long, features binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of every bucket over all rows. A task sends one total a bucket;
    ``buckets`` numbers reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for f in batch.column("features"):
                total += np.bincount(np.frombuffer(f.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    out = np.zeros(buckets, np.int64)
    for row in found.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of every bucket, in doubles."""
    s, t, k = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def noise(doc_id: Column, seed: int = 7) -> Column:
    """floor(1000 * Gumbel noise) from a hash of seed and doc_id (null: no digits)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20,
             buckets: int = BUCKETS, longest: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of docs (doc_id,
    text); target (text) shows what is wanted. rank is 1, 2, 3, ... over the drawn:
    floor(percent * N / 100) highest scores of the N rows with at least least_words
    words, ties to the smaller doc_id (null first); null for the others.

    Null and empty texts have no features, weight 0 and are never drawn where
    least_words > 0. Rows that repeat a doc_id are rows of their own: they share the
    noise, and of equal scores their order is free. Empty tables give no rows; an
    empty target leaves gains of the corpus alone. Other columns of docs and target,
    whatever their names, are not read. Very long texts are scanned whole; a task
    holds the words of about ``SLICE`` bytes of texts, or of one longer text.

    Every row is scanned once; its buckets are written, and counting and scoring read
    those. Ranks are places in a range sort of slim rows plus totals by run, so equal
    scores or one repeated doc_id never meet in one task.
    """
    found = materialise(features(docs, "doc_id", buckets, longest), "features")
    wanted = features(target.select("text").withColumn("_none", F.lit(None).cast("long")), "_none", buckets, longest)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets)))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, w = [], []
            for f in batch.column("features"):
                at = np.frombuffer(f.as_buffer(), kind)
                n.append(len(at))
                w.append(int(gain.value[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(w, pa.int64())],
                                             ["doc_id", "n_words", "n_features", "weight"])
    weighed = found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
                         .withColumn("row", F.monotonically_increasing_id()), "scores")
    able = numbered(scored.where(F.col("n_words") >= least_words), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "row", name="ranks")
    runs = able.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a sorted run
    starts = runs.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"),
                         F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("quota"))
    own = ["doc_id", "n_words", "n_features", "weight", "score"]
    rank = F.col("ahead") + F.col("at") + 1
    ranked = able.join(starts, "part").select(*own, F.when(rank <= F.col("quota"), rank).cast("long").alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select(*own, F.lit(None).cast("long").alias("rank"))
    return ranked.union(rest)
