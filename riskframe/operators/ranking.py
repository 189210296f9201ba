"""Scale helpers shared by splits, folds, ROC and threshold operators.

No helper here uses a window without a partition key over table-sized data:
global order statistics are done in two levels (bucket totals on a small
table, then a window inside each bucket), so the work spreads over many
tasks even when one class or one group holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROW_LIMIT

ALL = "_all"  # constant group column so that grouped and global forms share code


def sized_broadcast(small: DataFrame, limit: int = BROADCAST_ROW_LIMIT,
                    known_rows: int | None = None) -> DataFrame:
    """Broadcast ``small`` only when its size is proven to be at most
    ``limit`` rows; otherwise return it unchanged so the join shuffles.

    The proof is either ``known_rows`` — an upper bound the caller derives
    from the construction (e.g. groups x buckets) — or a count; in the latter
    case the frame is cached first so the count and the join read one
    computation."""
    if known_rows is not None and known_rows <= limit:
        return F.broadcast(small)
    small = small.cache()
    n = small.count()
    return F.broadcast(small) if n <= limit else small


def with_all_group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add a constant group column when ``by`` is empty."""
    if by:
        return df, list(by)
    return df.withColumn(ALL, F.lit(0)), [ALL]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (grouping semantics)."""
    ren = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(ren)
    cond = [left[k].eqNullSafe(r[ren[k]]) for k in keys]
    return left.join(r, cond, how).drop(*ren.values())


def hash_order_key(key: Column, seed: int | str) -> Column:
    """md5 of ``seed|key`` (lower-case hex): a reproducible pseudo-random
    order that is the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def auto_hex_digits(n_rows: int, rows_per_bucket: int = 1_000_000) -> int:
    """Hex prefix length so that an average (group, bucket) holds at most
    ``rows_per_bucket`` rows: 3 digits (4096 buckets) up to ~4e9 rows, then one
    more digit per factor 16."""
    digits = 3
    while n_rows / (16 ** digits) > rows_per_bucket and digits < 8:
        digits += 1
    return digits


def rank_within(df: DataFrame, groups: Sequence[str], order_hex: str,
                tie: str, out: str = "rank", hex_digits: int | None = None,
                return_counts: bool = False):
    """Exact 1-based ``row_number() over (partition by groups order by
    order_hex, tie)`` without a per-group single-task window.

    ``order_hex`` is a lower-case hex string column (an md5). Level 1: rows are
    bucketed by its first ``hex_digits`` digits (by default sized from the row
    count: 4096 buckets up to ~4e9 rows, 16x more per further digit), counted
    per (group, bucket), and the small count table
    gets exclusive prefix sums. Level 2: ``row_number`` inside each
    (group, bucket) plus the bucket offset. The order key is expected to be a
    row id (splits and folds hash unique keys); a key repeated on a large
    share of rows would fall into a single bucket. With ``return_counts`` the cached
    (group, bucket, count) table is returned too (it also gives group sizes
    without another pass over the rows) with the number of groups."""
    from pyspark import StorageLevel
    if hex_digits is None:
        hex_digits = auto_hex_digits(df.count())
    b = "_rk_bucket"
    d = df.withColumn(b, F.conv(F.substring(F.col(order_hex), 1, hex_digits), 16, 10)
                      .cast("long"))
    counts = (d.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("_rk_n"))
                .persist(StorageLevel.MEMORY_AND_DISK))
    w = (Window.partitionBy(*groups).orderBy(b)
         .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*groups, b,
                            F.coalesce(F.sum("_rk_n").over(w), F.lit(0)).alias("_rk_off"))
    # one count (it also materialises the cached counts) proves the size of
    # every per-(group, bucket) and per-group table derived from it
    n_groups = counts.select(*groups).distinct().count() if groups else 1
    bound = n_groups * 16 ** hex_digits
    joined = null_safe_join(d, sized_broadcast(offsets, known_rows=bound), [*groups, b])
    w2 = Window.partitionBy(*groups, b).orderBy(F.col(order_hex), F.col(tie))
    ranked = joined.withColumn(out, F.row_number().over(w2) + F.col("_rk_off")) \
                   .drop(b, "_rk_off")
    if return_counts:
        class_n = counts.groupBy(*groups).agg(F.sum("_rk_n").alias("n_c"))
        return ranked, class_n, n_groups
    return ranked


def range_splits(df: DataFrame, column: str, n_buckets: int,
                 rel_err: float = 0.001, n_rows: int | None = None,
                 per_bucket_sample: int = 200, seed: int = 42) -> list[float]:
    """Bucket boundaries of ``column`` from Spark's approximate quantiles
    (bounded memory; only ``n_buckets + 1`` numbers reach the driver). The
    boundaries only balance the buckets — exactness never depends on them —
    so when ``n_rows`` is known and large, they are taken from a seeded
    sample of about ``per_bucket_sample`` values per bucket. The outer
    splits are -inf/+inf so every value has a bucket."""
    if n_buckets <= 1:
        return [float("-inf"), float("inf")]
    probs = [i / n_buckets for i in range(1, n_buckets)]
    target = per_bucket_sample * n_buckets
    if n_rows is not None and n_rows > 2 * target:
        df = df.sample(False, target / n_rows, seed)
        rel_err = min(rel_err, 0.25 / n_buckets)
    qs = df.approxQuantile(column, probs, rel_err)
    inner = sorted({float(x) for x in qs if x == x and abs(x) != float("inf")})
    return [float("-inf"), *inner, float("inf")]


def bucketize(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    """Bucket index by binary search over ``splits`` (JVM side).
    Bucket i holds splits[i] <= x < splits[i+1]."""
    tmp = f"{out}__d"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    res = b.transform(df.withColumn(tmp, F.col(column).cast("double")))
    return res.withColumn(out, F.col(out).cast("int")).drop(tmp)


def prefix_before(df: DataFrame, groups: Sequence[str], order: str,
                  values: Sequence[str], prefix: str = "before_") -> DataFrame:
    """Exclusive running sums of ``values`` within each group in ``order``.
    For small tables (bucket totals, grids) only."""
    w = (Window.partitionBy(*groups).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(prefix + v)
                            for v in values])


def auto_buckets(n_rows: int, minimum: int = 256, rows_per_bucket: int = 1_000_000,
                 maximum: int = 100_000) -> int:
    """Bucket count that keeps about ``rows_per_bucket`` rows per bucket."""
    return int(min(maximum, max(minimum, n_rows // rows_per_bucket + 1)))


def two_level_prefix(df: DataFrame, groups: Sequence[str], order: str,
                     values: Sequence[str], n_buckets: int | None = None,
                     prefix: str = "before_", n_groups: int | None = None,
                     n_rows: int | None = None) -> DataFrame:
    """Exact exclusive prefix sums of ``values`` over ``order`` within each
    group, for tables of any size: range buckets on ``order`` (approximate
    quantiles; the bucket count grows with the row count), bucket totals
    (small) → prefix → joined back, then a running sum inside each
    (group, bucket)."""
    if n_buckets is None:
        n_rows = df.count() if n_rows is None else n_rows
        n_buckets = auto_buckets(n_rows)
    splits = range_splits(df, order, n_buckets, n_rows=n_rows)
    b = "_pf_bucket"
    d = bucketize(df, order, splits, b)
    tot = d.groupBy(*groups, b).agg(*[F.sum(v).alias(v) for v in values])
    off = prefix_before(tot, groups, b, values, prefix="_pf_off_").drop(*values)
    bound = None if n_groups is None else n_groups * (len(splits) - 1)
    j = null_safe_join(d, sized_broadcast(off, known_rows=bound), [*groups, b])
    w = (Window.partitionBy(*groups, b).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, -1))
    return j.select(
        *[c for c in d.columns if c != b],
        *[(F.col("_pf_off_" + v) + F.coalesce(F.sum(v).over(w), F.lit(0))).alias(prefix + v)
          for v in values])


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: Sequence[float], n_buckets: int | None = None,
                    rows_per_bucket: int = 2_000_000) -> DataFrame:
    """Exact linear-interpolation quantiles (the definition used by
    ``percentile`` / pandas / ``quantile_cont``) of ``value`` per group, for
    columns of any size and cardinality.

    Two-level selection: range buckets from an approximate-quantile sketch;
    per (group, bucket) counts (small) give each target rank's bucket; only
    the rows of the (at most 2 x len(probs)) target buckets per group are
    ranked, inside their bucket. Output: groups + ``q{i}`` per probability.
    Nulls and NaN are ignored."""
    v = F.col(value)
    d = df.where(v.isNotNull() & ~F.isnan(v)).select(*groups, v.cast("double").alias("_v"))
    n_rows = d.count()
    if n_buckets is None:  # keep the rows ranked inside one bucket bounded
        n_buckets = int(min(100_000, max(1024, n_rows // rows_per_bucket + 1)))
    splits = range_splits(d, "_v", n_buckets, rel_err=min(0.001, 0.5 / n_buckets),
                          n_rows=n_rows)
    b = bucketize(d, "_v", splits, "_qb")
    from pyspark import StorageLevel
    # small (groups x buckets) and read three times: persist it
    cnt = (b.groupBy(*groups, "_qb").agg(F.count(F.lit(1)).alias("_n"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    w = Window.partitionBy(*groups).orderBy("_qb")
    cnt = cnt.select(*groups, "_qb", "_n",
                     (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("_lo"),
                     F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding,
                                                    Window.unboundedFollowing)).alias("_tot"))
    cnt = cnt.fillna(0, ["_lo"])
    # target 0-based ranks: floor and ceil of (n - 1) * p, per probability
    targets = []
    for i, p in enumerate(probs):
        h = (F.col("_tot") - 1) * F.lit(float(p))
        for side, r in (("f", F.floor(h)), ("c", F.ceil(h))):
            targets.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                                    r.cast("long").alias("r"), h.alias("h")))
    t = cnt.select(*groups, "_qb", "_lo", "_n", F.explode(F.array(*targets)).alias("t"))
    t = t.where((F.col("t.r") >= F.col("_lo")) & (F.col("t.r") < F.col("_lo") + F.col("_n")))
    t = t.select(*groups, "_qb", (F.col("t.r") - F.col("_lo") + 1).alias("_pos"),
                 F.col("t.i").alias("_i"), F.col("t.side").alias("_side"), F.col("t.h").alias("_h"))
    want = sized_broadcast(t)  # <= groups x 2 x len(probs) rows, size-checked
    hit = null_safe_join(b, want.select(*groups, "_qb").distinct(), [*groups, "_qb"], "left_semi")
    # Collapse each target bucket to distinct (value, count) first (map-side),
    # so a value repeated on a third of the rows is one row, not one task's
    # sort; then cumulative counts in value order locate each target rank.
    dv = hit.groupBy(*groups, "_qb", "_v").agg(F.count(F.lit(1)).alias("_c"))
    wr = (Window.partitionBy(*groups, "_qb").orderBy("_v")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dv = dv.select(*groups, "_qb", "_v", F.sum("_c").over(wr).alias("_cum"), "_c")
    picked = null_safe_join(dv, want, [*groups, "_qb"]).where(
        (F.col("_pos") > F.col("_cum") - F.col("_c")) & (F.col("_pos") <= F.col("_cum")))
    agg = picked.groupBy(*groups, "_i").agg(
        F.max(F.when(F.col("_side") == "f", F.col("_v"))).alias("_vf"),
        F.max(F.when(F.col("_side") == "c", F.col("_v"))).alias("_vc"),
        F.first("_h").alias("_h"))
    q = F.col("_vf") + (F.col("_vc") - F.col("_vf")) * (F.col("_h") - F.floor("_h"))
    res = agg.select(*groups, "_i", q.alias("_q"))
    out = res.groupBy(*groups).pivot("_i", list(range(len(probs)))).agg(F.first("_q"))
    cols = [*groups, *[F.col(str(i)).alias(f"q{i}") for i in range(len(probs))]]
    if not groups:
        return out.select(*cols)
    # group sizes come free from the bucket counts (non-null values)
    sizes = cnt.groupBy(*groups).agg(F.sum("_n").alias("n"))
    return null_safe_join(out, sizes, groups).select(*cols, "n")
