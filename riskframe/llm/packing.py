"""Best-fit packing of token pieces into sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. The fullest feasible
combination of lengths for a bin is found by a bitset subset-sum over the lengths
still available and removed as often as its lengths last, so the plan depends on
the histogram of lengths (at most ``capacity`` numbers) and not on the number of
pieces. Pieces then take the planned places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, materialise, spread, text_batches
from .tokens import word_ids

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every row of docs (doc_id, text): its token ids, then end_id, cut
    every ``capacity`` tokens. Null and empty texts are the end id alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for (ids,), texts in text_batches(batches, "doc_id", limit=2 << 20):
            out = [(i, k, s // 4, len(p) // 4, zlib.crc32(p))
                   for i, own in zip(ids, words.of(texts), strict=True)
                   for data in (own + end,)
                   for k, s in enumerate(range(0, len(data), 4 * capacity))
                   for p in (data[s:s + 4 * capacity],)]
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _fill(left: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the largest sum up to room, as
    (length, copies). Bit s of ``reach`` is set when the sum s is feasible; every
    length enters in doubling multiples, and the way back follows the steps at
    which a sum first became feasible."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for size in lengths:
        if size > room:
            continue
        copies, chunk = min(left[size], room // size), 1
        while copies > 0:
            chunk = min(chunk, copies)
            steps.append((size, chunk, reach))
            reach |= reach << size * chunk & mask
            copies -= chunk
            chunk *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for size, chunk, before in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + chunk
            total -= size * chunk
    return list(used.items())


def minimum_slack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (times, [(length, copies), ...]): the longest length left opens the
    bin, the subset-sum fills it, and the pattern repeats while its lengths last.
    A pattern uses up a length or leaves fewer of it than a bin would take, so
    there are at most capacity * (1 + ln capacity) patterns for any corpus."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    lengths = sorted(left, reverse=True)
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        used = dict(_fill(left, lengths, capacity - longest)) if longest < capacity else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= times * c
        plan.append((times, sorted(used.items(), reverse=True)))
        lengths = [n for n in lengths if left[n]]
    return plan


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: ranks [first, first + times * copies) of a
    length go to sequences from ``seq`` on, ``copies`` in each, from ``offset`` on."""
    taken: dict[int, int] = {}
    rows, seq = [], 0
    for times, used in plan:
        offset = 0
        for n, c in used:
            rows.append((n, taken.get(n, 0), seq, offset, c))
            taken[n] = taken.get(n, 0) + times * c
            offset += n * c
        seq += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "first": a[:, 1], "seq": a[:, 2], "offset": a[:, 3], "copies": a[:, 4]}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length <= capacity) plus sequence_id and offset.

    Every row gets a place, repeated rows too; places in a sequence have no gap
    from 0. Ranks within a length are taken in two levels (salt totals, then a
    window inside length and salt), so a length that holds most rows is spread.
    The histogram (one row per length, at most ``capacity``) is all that reaches
    the driver, and the slots sent to tasks are bounded with it.
    """
    spark: SparkSession = pieces.sparkSession
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rows = pieces.count()
    pieces = pieces.withColumn("salt", bucket_of("doc_id", "piece", buckets=spread(rows, 10_000)))
    totals = materialise(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(minimum_slack_plan(histogram, capacity)))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = (pieces.join(starts, ["length", "salt"])
              .withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
              .select("doc_id", "piece", "start", "length", "ids_crc32", "rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        first_of = np.searchsorted(s["length"], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = first_of[n], first_of[n + 1]
                at[own] = lo + np.searchsorted(s["first"][lo:hi], rank[own], "right") - 1
            nth, copies = rank - s["first"][at], s["copies"][at]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(s["seq"][at] + nth // copies), pa.array(s["offset"][at] + nth % copies * length)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack docs (doc_id, text); one row per piece."""
    return pack_pieces(tokenized_pieces(docs, tokenizer_path, capacity), capacity)
