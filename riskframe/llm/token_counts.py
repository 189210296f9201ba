"""Token counts: pieces are counted once per distinct pre-token, joined to
per-document pre-token frequencies, and summed; no ids are kept.

The frequencies travel by block, a slice of some MB of documents: a block holds
its distinct pre-tokens once and, per document, (pre-token number, frequency)
pairs, so the join moves a pre-token once per block and not once per document. It is
one exchange: a block's pre-tokens are dealt by hash into buckets and travel packed, a
row per block and bucket; a bucket counts each of its pre-tokens once, and the counts
go back to their blocks packed. Buckets follow the number of pre-tokens, so what a task
holds of one bucket at a time does not grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread, text_batches
from .tokens import STRETCH, PreTokens, load, piece_counts, pre_tokens

#: Counts that a task packs at a time.
PACKED = 1_000_000
#: Pre-tokens, counted by block, for each bucket.
PER_BUCKET = 1_000_000
BLOCK = "doc_ids array<long>, n_bytes array<long>, ends array<long>, pairs binary, pre_tokens array<string>"


def _ids_of(values: list, numbers: dict) -> list[int]:
    return [numbers.setdefault(v, len(numbers)) for v in values]


def frequencies(texts: list[bytes], pre: PreTokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(ends, number, frequency, pre_tokens): document i has the pairs from
    ends[i - 1] to ends[i], sorted by number."""
    stretches: dict[str, int] = {}
    flat, sizes = [], []
    for t in texts:
        own = _ids_of(STRETCH.findall(t.decode("utf-8", "replace")), stretches)
        flat.append(np.array(own, np.int64))
        sizes.append(len(own))
    numbers: dict[str, int] = {}
    cuts = [_ids_of(pre.of(s), numbers) for s in stretches]
    lens = np.array([len(c) for c in cuts], np.int64)
    ptr = np.concatenate(([0], np.cumsum(lens)))
    parts = np.array([p for c in cuts for p in c], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    sid = np.concatenate(flat) if flat else np.empty(0, np.int64)
    key, times = np.unique(doc * max(1, len(stretches)) + sid, return_counts=True)
    doc, sid = key // max(1, len(stretches)), key % max(1, len(stretches))
    n = lens[sid] if len(sid) else np.empty(0, np.int64)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    number = parts[np.repeat(ptr[sid], n) + within] if len(sid) else np.empty(0, np.int64)
    pair, back = np.unique(np.repeat(doc, n) * max(1, len(numbers)) + number, return_inverse=True)
    freq = np.bincount(back, np.repeat(times, n), len(pair)).astype(np.int64)
    ends = np.searchsorted(pair // max(1, len(numbers)), np.arange(len(texts)), "right")
    return ends, pair % max(1, len(numbers)), freq, list(numbers)


def dealt(names: list[str], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, how many, packed) of a block's pre-tokens, the position in names being a pre-token's
    number: the numbers, the lengths and the UTF-8 bytes of a bucket's pre-tokens."""
    raw = [x.encode() for x in names]
    bucket = np.fromiter((zlib.crc32(x) % buckets for x in raw), np.int64, len(raw))
    size = np.fromiter(map(len, raw), "<u4", len(raw))
    order = np.argsort(bucket, kind="stable")
    own, start = np.unique(bucket[order], return_index=True)
    packer = zstandard.ZstdCompressor(level=1)
    for b, part in zip(own.tolist(), np.split(order, start[1:]), strict=True):
        yield b, len(part), packer.compress(part.astype("<u4").tobytes() + size[part].tobytes() + b"".join([raw[i] for i in part.tolist()]))


def undealt(n: int, data: bytes) -> tuple[np.ndarray, list[str]]:
    """(numbers, pre-tokens) of n pre-tokens that ``dealt`` packed."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4 * n).astype(np.int64)) + 8 * n
    starts = [8 * n, *ends[:-1].tolist()]
    return np.frombuffer(raw, "<u4", n), [raw[a:b].decode() for a, b in zip(starts, ends.tolist(), strict=True)]


def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(of_block, counts) of (block, number, count) arrays: a row per block with its
    numbers, sorted, and their counts."""
    block, number, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((number, block))
    block, number, n = block[order], number[order].astype("<u4"), n[order].astype("<u4")
    own, start = np.unique(block, return_index=True)
    packer, ends = zstandard.ZstdCompressor(level=1), [*start[1:].tolist(), len(block)]
    counts = [packer.compress(number[a:b].tobytes() + n[a:b].tobytes()) for a, b in zip(start.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts, pa.binary())], ["of_block", "counts"])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of
    docs (doc_id, text). Null and empty texts have 0 bytes and tokens; repeated
    rows are counted each."""
    def block_of(pre: PreTokens, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        """One row for a slice; what it took to make it is freed before the next slice."""
        ends, number, freq, names = frequencies(texts, pre)
        step = np.diff(number, prepend=0).astype("<i4")
        pairs = zstandard.ZstdCompressor(level=1).compress(step.tobytes() + freq.astype("<u4").tobytes())
        cols = [[ids], [[len(t) for t in texts]], [ends.tolist()], [pairs], [names]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          ["doc_ids", "n_bytes", "ends", "pairs", "pre_tokens"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pre_tokens(tokenizer_path)
        for (ids,), texts in text_batches(batches, "doc_id"):
            yield block_of(pre, ids, texts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, names in zip(batch.column("block").to_pylist(), batch.column("pre_tokens"), strict=True):
                parts = list(dealt(names.as_py(), buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()),
                     pa.array([n for _, n, _ in parts], pa.int32()), pa.array([d for _, _, d in parts], pa.binary())],
                    ["bucket", "block", "size", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket: (block, number, n) of each pre-token, packed by block."""
        tokenizer = load(tokenizer_path)
        at, known, held, rows = None, {}, [], 0
        for batch in batches:
            for bucket, block, size, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "size", "data")), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                number, names = undealt(size, data)
                new = [x for x in names if x not in known]
                known.update(zip(new, piece_counts(tokenizer, new), strict=True))
                n = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
                held.append((np.full(len(n), block), number, n))
                rows += len(n)
                if rows >= PACKED:
                    yield packed(held)
                    held, rows = [], 0
        if held:
            yield packed(held)

    def total(block: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out, unpack = [], zstandard.ZstdDecompressor().decompress
        told = [np.frombuffer(unpack(x), "<u4").reshape(2, -1) for x in counts["counts"]]
        for row in block.itertuples():
            raw = unpack(row.pairs)
            half = len(raw) // 2
            number = np.cumsum(np.frombuffer(raw[:half], "<i4").astype(np.int64))
            n = np.zeros(max((int(t[0].max()) for t in told), default=0) + 1, np.int64)
            for t in told:
                n[t[0]] = t[1]
            sums = np.concatenate(([0], np.cumsum(np.frombuffer(raw[half:], "<u4") * n[number])))
            ends = np.asarray(row.ends, np.int64)
            out.append(pd.DataFrame({"doc_id": pd.array(row.doc_ids, "Int64"), "n_bytes": row.n_bytes,
                                     "n_tokens": sums[ends] - sums[np.concatenate(([0], ends[:-1]))]}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_bytes": [], "n_tokens": []})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = materialise(src.mapInArrow(blocks, BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
    many = held.agg(F.sum(F.size("pre_tokens").cast("long"))).first()[0] or 0
    buckets = spread(many, PER_BUCKET)
    names = held.select("block", "pre_tokens").mapInArrow(deal, "bucket long, block long, size int, data binary")
    # all rows of a bucket in one task, next to each other: a pre-token is counted once
    own = (names.repartition(buckets, "bucket").sortWithinPartitions("bucket")
           .mapInArrow(count, "of_block long, counts binary"))
    left = held.select("block", "doc_ids", "n_bytes", "ends", "pairs")
    sums = (left.groupBy("block").cogroup(own.groupBy("of_block"))
            .applyInPandas(total, "doc_id long, n_bytes long, n_tokens long"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
