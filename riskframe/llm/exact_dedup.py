"""Exact dedup by content-defined chunk recipes.

A text without white space is cut into chunks where a rolling hash of its last
16 bytes meets a mask, so equal stretches give equal chunks. Chunks are
deduplicated to identifiers, verified byte by byte wherever a key recurs with
other bytes; a document is then the ordered list of its identifiers (its
recipe), and equal recipes are equal texts. Chunk bytes cross the network once
per task and distinct chunk; documents travel as recipes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialise, rows_with_number, small, text_batches

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 256, 16384, 10
KEY_BYTES = 16
_GEAR = np.random.default_rng(20240601).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, mask_bits: int = MASK_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the content-defined chunks: where the gear hash of the last 16
    bytes has mask_bits low zero bits, at least ``least`` bytes apart and at most
    ``most``. Empty data has no chunk."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    cuts = np.flatnonzero(h & np.uint32(((1 << mask_bits) - 1) << 8) == 0) + 1
    ends, last = [], 0
    for cut in [*cuts.tolist(), n]:
        while cut - last > most:
            last += most
            ends.append(last)
        if cut - last >= least or cut == n and cut > last:
            ends.append(cut)
            last = cut
    return ends


def _recipes(key_bytes: int, with_chunks: bool):
    """Rows (doc_id, row, n_cp, sha, recipe) of documents, or (key, chunk) of chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, at), texts in text_batches(batches, "doc_id", "row"):
            keys, chunks, n_cp, sha, recipes = [], [], [], [], []
            for t in texts:
                data = t.translate(None, SPACES)
                ends, start, own = chunk_ends(data), 0, []
                for end in ends:
                    c = data[start:end]
                    own.append(xxhash.xxh3_128_digest(c)[:key_bytes])
                    if with_chunks:
                        chunks.append(c)
                    start = end
                if with_chunks:
                    keys += own
                else:
                    n_cp.append(len(t.decode("utf-8", "replace")))
                    sha.append(hashlib.sha256(data).hexdigest())
                    recipes.append(b"".join(own))
            if with_chunks:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(chunks, pa.binary())], ["key", "chunk"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(n_cp, pa.int64()), pa.array(sha, pa.string()),
                     pa.array(recipes, pa.binary())], ["doc_id", "row", "n_cp", "text_sha256", "recipe"])
    return run


def exact_groups(docs: DataFrame, key_bytes: int = KEY_BYTES, number: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept,
    text_sha256.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and all empty texts are one group. Of a group the row with the most
    code points in the original text stays, then the smallest doc_id (null
    last); of repeated rows that tie in both, exactly one stays. key_bytes sets
    the length of a chunk key: any length gives the same result, as keys that
    stand for several byte strings are told apart by an ordinal. number names a
    column with a number of its own for every row, returned as ``row``: rows that
    tie are then told apart by it.
    """
    at = F.monotonically_increasing_id() if number is None else F.col(number).cast("long")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", at.alias("row"))
    rows = materialise(
        src.mapInArrow(_recipes(key_bytes, False), "doc_id long, row long, n_cp long, text_sha256 string, recipe binary"), "recipes")
    chunks = src.mapInArrow(_recipes(key_bytes, True), "key binary, chunk binary")
    # partial aggregation moves a chunk once per task that holds it
    distinct = chunks.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    clashes = materialise(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "clashes")
    if not clashes.isEmpty():
        rows = _tell_apart(src, rows, chunks, clashes, key_bytes)
    best = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.max("n_cp").alias("n_cp"))
    # three aggregates with fixed-width states instead of one over a struct: no sort
    first = (rows.join(best, ["recipe", "n_cp"]).groupBy("recipe")
             .agg(F.min("doc_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max("n_cp").alias("n_cp")))
    one = (rows.alias("r").join(first.alias("f"), (F.col("r.recipe") == F.col("f.recipe")) & (F.col("r.n_cp") == F.col("f.n_cp"))
                                & F.col("r.doc_id").eqNullSafe(F.col("f.keep_id")))
           .groupBy("f.recipe").agg(F.min("row").alias("keep_row")))
    groups = materialise(first.join(one, "recipe").select("recipe", "keep_id", "group_size", "keep_row"), "groups")
    return (rows.join(groups, "recipe")
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256",
                    *(["row"] if number else [])))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns stay, whatever
    their names. Only rows whose text has copies are written, with a number, and judged
    one by one: also rows without a doc_id, several texts under one doc_id, and repeated
    rows, of which one stays. The others are told by a hash of their text; a text that
    shares the hash of one with copies is written and judged too. docs is read several
    times and must give the same rows each time."""
    found = exact_groups(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), number="key")
    several = small(materialise(found.where("group_size > 1").select(F.col("row").alias("_key")).distinct(), "several"))
    copied = F.xxhash64(docs["text"]) == several["_key"]
    rows = rows_with_number(docs.join(several, copied, "left_semi"), "doc_id", "text", name="rows")
    gone = materialise(exact_groups(rows, number="at").where("NOT kept").select(F.col("row").alias("gone")), "gone")
    kept = rows.select("row", "at").join(small(gone), F.col("at") == F.col("gone"), "left_anti").select("row.*")
    return docs.join(several, copied, "left_anti").unionAll(kept)


def _tell_apart(src: DataFrame, rows: DataFrame, chunks: DataFrame, clashes: DataFrame, key_bytes: int) -> DataFrame:
    """Recipes in which every key carries the ordinal of its own bytes."""
    names = materialise(
        chunks.join(clashes, "key", "left_semi").distinct()
        .withColumn("ordinal", F.row_number().over(Window.partitionBy("key").orderBy("chunk")).cast("int")), "names")
    parts = src.mapInArrow(_pieces(key_bytes), "doc_id long, text_sha256 string, pos int, key binary, chunk binary")
    told = (parts.join(names, ["key", "chunk"], "left")
            .groupBy("doc_id", "text_sha256")
            .agg(F.sort_array(F.collect_set(F.struct("pos", "key", F.coalesce("ordinal", F.lit(0)).alias("o")))).alias("x"))
            .select("doc_id", "text_sha256", F.concat_ws("|", F.transform(
                "x", lambda c: F.concat(F.hex(c["key"]), F.lit("."), c["o"].cast("string")))).cast("binary").alias("told")))
    return materialise(
        rows.alias("r").join(told.alias("t"), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id"))
                             & (F.col("r.text_sha256") == F.col("t.text_sha256")), "left")
        .select("r.doc_id", "n_cp", "r.text_sha256", F.coalesce("told", "recipe").alias("recipe"), "row"), "recipes")


def _pieces(key_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in text_batches(batches, "doc_id"):
            out: list[tuple] = []
            for i, t in zip(ids, texts, strict=True):
                data, start = t.translate(None, SPACES), 0
                sha = hashlib.sha256(data).hexdigest()
                for pos, end in enumerate(chunk_ends(data)):
                    c = data[start:end]
                    out.append((i, sha, pos, xxhash.xxh3_128_digest(c)[:key_bytes], c))
                    start = end
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "text_sha256", "pos", "key", "chunk"])
    return run
