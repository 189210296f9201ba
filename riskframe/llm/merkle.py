"""Merkle manifest of a dataset by nested-interval labels.

Every row is a leaf with a rank in its tree; a node at level l carries the interval
of leaf ranks [lo, hi] that it covers, at most arity ** l of them. Levels are taken
in bands: nodes of a band are bucketed by the interval of the band's upper level
(at most arity ** HEIGHT to a bucket), so a bucket is a bounded subtree and a tree
of any size, also one that holds most rows, is spread over tasks. On the way up,
buckets yield their top nodes, which are the next band's nodes. On the way down,
each bucket is joined with the node of the level above whose interval contains its
own; what a parent's interval covers besides a node's own interval are its siblings.
Tops of the trees are the leaves of one more tree, built in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered

#: Levels to a band: a bucket holds at most 3 ** 6 = 729 nodes.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, size long, lo long, hi long, digest string"
_PATH = "tree string, lo long, hi long, left array<string>, right array<string>, top string, root string"


def digest_of(*fields: Column) -> Column:
    """Hex sha256 of the fields in a row: ``-`` for null, else UTF-8 bytes, ``:``, value."""
    said = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*said), 256)


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(size: int, arity: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // arity), n + 1
    return n


def ranked_leaves(rows: DataFrame, order: str) -> DataFrame:
    """rows (tree, order, digest, ..., all written) with size, the number of rows of
    their tree, and lo = hi, their rank in it by order (nulls first), then digest.

    Ranks are places in one range sort of all trees plus totals by (run, tree).
    """
    s = numbered(rows, "tree", F.col(order).asc_nulls_first(), "digest", "row", name="leaves")
    runs = materialise(s.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "runs")
    one = Window.partitionBy("tree")
    ahead = one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "tree", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(one).alias("size"))
    return (s.join(runs, ["part", "tree"]).withColumn("lo", F.col("at") + F.col("shift"))
            .withColumn("hi", F.col("lo")).drop("part", "at", "row", "shift"))


def _buckets(nodes: DataFrame, width: int, carried: list[str]) -> DataFrame:
    """One row per bucket: its nodes in order of lo, and the interval they cover."""
    member = F.struct("lo", "hi", "digest", *carried)
    b = (nodes.withColumn("bucket", F.expr(f"lo div {width}L")).groupBy("tree", "size", "bucket")
         .agg(F.sort_array(F.collect_list(member)).alias("members")))
    return materialise(b.withColumn("lo", F.element_at("members", 1)["lo"]).withColumn("hi", F.element_at("members", -1)["hi"]), "buckets")


def _subtree(members: list[dict], arity: int, below: int, levels: int) -> list[list[tuple[int, int, str]]]:
    """The (lo, hi, digest) nodes of a bucket, level by level; members cover arity ** below ranks each."""
    rows = [[(m["lo"], m["hi"], m["digest"]) for m in members]]
    for up in range(1, levels + 1):
        span, runs = arity ** (below + up), {}
        for node in rows[-1]:
            runs.setdefault(node[0] // span, []).append(node)
        rows.append([(r[0][0], r[-1][1], _hash(*(n[2] for n in r))) for r in runs.values()])
    return rows


def _climb(nodes: DataFrame, arity: int, height: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(buckets of every band, roots (tree, size, digest) of all trees) from leaves."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    bands, roots = [], nodes.where("size = 1").select("tree", "size", "digest")
    while arity ** (height * len(bands)) < largest:
        band = len(bands)
        low, high = arity ** (height * band), arity ** (height * (band + 1))
        buckets = _buckets(nodes.where(F.col("size") > low), high, carried if band == 0 else [])

        def up(batches: Iterator[pa.RecordBatch], band: int = band) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for b in batch.to_pylist():
                    levels = min(height, _levels(b["size"], arity) - height * band)
                    (lo, hi, digest), = _subtree(b["members"], arity, height * band, levels)[-1]
                    out.append((b["tree"], b["size"], lo, hi, digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                                 ["tree", "size", "lo", "hi", "digest"])
        nodes = materialise(buckets.mapInArrow(up, _NODE), "nodes")
        roots = roots.union(nodes.where(F.col("size") <= high).select("tree", "size", "digest"))
        bands.append(buckets)
    return bands, roots


def _descend(bands: list[DataFrame], leaves: DataFrame, tops: DataFrame, arity: int, height: int, carried: list[str], types: str) -> DataFrame:
    """tree, digest, carried, left, right, top, root for every leaf: the digests of the
    siblings on either side, one entry a level from the leaf to tops' root.

    tops has a row per tree: (tree, size, left, right, top, root), the path above it.
    """
    whole = tops.select("tree", "size", F.lit(0).cast("long").alias("lo"), (F.col("size") - 1).alias("hi"), "left", "right", "top", "root")
    path = [c.split()[0] for c in _PATH.split(", ")]
    below = None
    for band in reversed(range(len(bands))):
        low, high = arity ** (height * band), arity ** (height * (band + 1))
        above = whole.where((F.col("size") > low) & (F.col("size") <= high)).select(*path)
        above = above if below is None else above.union(below.select(*path))
        a = above.select(F.col("tree").alias("in_tree"), F.expr(f"lo div {high}L").alias("in_bucket"), F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"),
                         "left", "right", "top", "root")
        contains = ((F.col("tree") == F.col("in_tree")) & (F.col("bucket") == F.col("in_bucket"))
                    & (F.col("in_lo") <= F.col("lo")) & (F.col("hi") <= F.col("in_hi")))
        joined = bands[band].join(a, contains).select("tree", "size", "members", "left", "right", "top", "root")
        extra = carried if band == 0 else []
        schema = "digest string, " * (band == 0) + (types + ", " if extra else "") + _PATH
        names = (["digest"] if band == 0 else []) + extra + path

        def down(batches: Iterator[pa.RecordBatch], band: int = band, extra: list = extra, names: list = names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = {f.name: f.type for f in batch.schema.field("members").type.value_type}
                kinds |= {"tree": pa.string(), "left": pa.list_(pa.string()), "right": pa.list_(pa.string()), "top": pa.string(), "root": pa.string()}
                for b in batch.to_pylist():
                    yield _place(b, names, kinds, extra, arity, height, band)
        below = joined.mapInArrow(down, schema)
        if band:
            below = materialise(below, "paths")
    alone = leaves.where("size = 1").join(whole.where("size = 1").drop("size", "lo", "hi"), "tree")
    out = ["tree", "digest", *carried, "left", "right", "top", "root"]
    return alone.select(*out) if below is None else alone.select(*out).union(below.select(*out))


def _place(b: dict, names: list[str], kinds: dict, extra: list[str], arity: int, height: int, band: int) -> pa.RecordBatch:
    """The paths of a bucket's nodes: siblings in the bucket, then the path of the node above."""
    levels = min(height, _levels(b["size"], arity) - height * band)
    rows = _subtree(b["members"], arity, height * band, levels)
    paths = {rows[-1][0][0]: (b["left"], b["right"])}  # by lo, from the top level down
    for level in reversed(range(levels)):
        span, here = arity ** (height * band + level + 1), {}
        by_parent: dict[int, list] = {}
        for node in rows[level]:
            by_parent.setdefault(node[0] // span, []).append(node)
        for run in by_parent.values():
            left, right = paths[run[0][0]]
            for lo, hi, _ in run:  # the parent's interval less the node's own
                here[lo] = (["".join(n[2] for n in run if n[1] < lo), *left], ["".join(n[2] for n in run if n[0] > hi), *right])
        paths = here
    values = {"tree": [b["tree"]], "top": [b["top"]], "root": [b["root"]]}
    n = len(b["members"])
    cols = {k: v * n for k, v in values.items()}
    cols |= {k: [m[k] for m in b["members"]] for k in ("lo", "hi", "digest", *extra)}
    cols["left"] = [paths[m["lo"]][0] for m in b["members"]]
    cols["right"] = [paths[m["lo"]][1] for m in b["members"]]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], kinds[c]) for c in names], names)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", order: str = "doc_id",
             arity: int = 3, altered: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """order's column, tree's column, leaf, found, left, right, subroot, root for every
    row: leaf digests the fields, found the fields as ``altered`` changes them, and
    (left, right) is the inclusion proof, one entry of sibling digests a level from
    the leaf through its subroot to the root.

    Leaves of a tree ascend by order (nulls first); rows that share it stand by their
    digest, and equal ones are interchangeable, each with a place of its own. Null
    fields digest as ``-``; a null tree is a tree of its own, the first. Other columns,
    whatever their names, are not read. An empty table has no rows; a single one is
    its own root with an empty proof. Texts, also very long ones, are digested whole, in
    the JVM; only digests move. A bucket holds at most arity ** height nodes.
    """
    said = [F.col(c).cast("string") for c in fields]
    changed = [(altered or {}).get(c, F.col(c)).cast("string") for c in fields]
    # nulls first, and no string is before them: a mark in front keeps the bytes' order
    rows = materialise(docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("id"),
                                   digest_of(*said).alias("digest"), digest_of(*changed).alias("found"))
                       .withColumn("row", F.monotonically_increasing_id()), "digests")
    leaves = materialise(ranked_leaves(rows, "id"), "ranked")
    kind = rows.schema["id"].dataType.simpleString()
    bands, roots = _climb(leaves, arity, height, ["id", "found"])
    # the trees' roots are the leaves of one tree, in order of the trees
    subroots = materialise(roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("size").alias("found"), "digest")
                           .withColumn("row", F.monotonically_increasing_id()), "subroots")
    upper = materialise(ranked_leaves(subroots, "id"), "ranked")
    upper_bands, top = _climb(upper, arity, height, ["id", "found"])
    none = F.array().cast("array<string>")
    crown = top.select("tree", "size", none.alias("left"), none.alias("right"), F.col("digest").alias("top"), F.col("digest").alias("root"))
    tops = materialise(_descend(upper_bands, upper, crown, arity, height, ["id", "found"], "id string, found long")
                       .select(F.col("id").alias("tree"), F.col("found").alias("size"), "left", "right", F.col("digest").alias("top"), "root"), "tops")
    placed = _descend(bands, leaves, tops, arity, height, ["id", "found"], f"id {kind}, found string")
    return placed.select(F.col("id").alias(order), F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias(tree),
                         F.col("digest").alias("leaf"), "found", "left", "right", F.col("top").alias("subroot"), "root")


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf digest gives with the siblings of its proof."""
    steps = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["a"], acc, s["b"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def without_line_breaks(doc_id: Column, text: Column, every: int = 2) -> Column:
    """Tampering that the manifest must find: texts of rows where ``every`` divides the
    unsigned crc32 of the decimal doc_id lose their ``\\n``; nulls stay, and so does a
    row without doc_id."""
    return F.when(F.crc32(doc_id.cast("string")) % every == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
