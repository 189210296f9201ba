"""Shared helpers: columns of the input, written intermediate tables, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space of the contracts, ``[\x20\x09-\x0D]``; also what bytes.split() cuts at.
SPACES = b" \t\n\x0b\x0c\r"


#: Whether a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that begin inside go as soon as their query has ended;
    they would pile up until the driver's garbage collector finds them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the
    lineage, survives lost executors, and is compressed, unlike checkpoint().
    The query's shuffle files go when it is written."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_with_number(docs: DataFrame, *cols: str, name: str) -> DataFrame:
    """docs, written, as (row, at, cols): all of its columns in one struct, so that no
    helper column can clash with one of them, a number of each row, and copies of cols."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return materialise(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("at"))
                       .select("row", "at", *[F.col("row")[c].alias(c) for c in cols]), name, "zstd")


def slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20):
    """(slice of a batch, its texts as UTF-8 bytes with null as empty), about
    ``limit`` bytes each, so a task's memory does not follow the batch size."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            held += int(size)
            if held >= limit or i == len(sizes) - 1:
                n = i + 1 - start
                yield batch.slice(start, n), [t or b"" for t in text.slice(start, n).to_pylist()]
                start, held = i + 1, 0


def text_batches(batches: Iterator[pa.RecordBatch], *ids: str, limit: int = 8 << 20):
    """(lists of the ids columns, texts) by slices."""
    for part, texts in slices(batches, limit):
        yield [part.column(c).to_pylist() for c in ids], texts


def numbered(df: DataFrame, *order: str | Column, name: str) -> DataFrame:
    """df range-sorted by order and written, with ``part`` (sorted run, ascending in
    that order) and ``at`` (place in the run). End the order with a number of each row,
    so that a key that holds many rows is spread over runs; totals by part then turn
    places in a run into ranks, without a window over a whole group.

    df should read a written table: the range split samples it first.
    """
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(s.withColumn("part", F.spark_partition_id())
                       .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)


def bucket_of(*cols: str | Column, buckets: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(buckets)).cast("int")


def spread(rows: int, per_bucket: int = 2000, least: int = 64) -> int:
    """Buckets for about per_bucket rows each; follows the row count, no upper cap."""
    return max(least, -(-rows // per_bucket))


def _rounds(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component = smallest
    node reachable.

    Alternating large-star and small-star contraction: each round is two
    aggregations (partial on the map side, so a hub is one state per task) and
    two joins that AQE can split, over a working set that never grows past the
    edges. Every round is written to the shared folder. Self loops and repeated
    edges are allowed; null ends are dropped.
    """
    nodes = (edges.select(F.explode(F.array("u", "v")).alias("node")).where("node IS NOT NULL").distinct())
    e = materialise(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _rounds(e)
    while state[0]:
        both = e.select("u", "v").union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # the larger end keeps its smallest neighbour; its other neighbours move to that one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
                 .select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        e = materialise(small, "edges")
        before, state = state, _rounds(e)
        if before == state:
            break
    root = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return (nodes.join(root, "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, a written table of a few fixed-width columns, with a broadcast hint when
    it has at most ``rows`` rows; a join with a larger one shuffles."""
    return F.broadcast(df) if df.count() <= rows else df
