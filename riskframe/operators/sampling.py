"""Splits, folds, shuffles and samples.

Row order is a reproducible pseudo-random key, md5(seed|key), never a
position. Per-class quotas are computed on the tiny class-count table;
splits and samples find the cutoff key of a class from a histogram of hash
prefixes and decide every row where it lies; folds and shuffles, which need every
rank, use the two-level rank, so a class holding most of the rows still spreads
over thousands of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import (auto_hex_digits, hash_order_key, null_safe_join, prefix_before, rank_within,
                      sized_broadcast)


def _key(df: DataFrame, key: str | Sequence[str]) -> Column:
    if isinstance(key, str):
        return F.col(key)
    return F.concat_ws("|", *[F.col(k).cast("string") for k in key])


def class_quotas(df: DataFrame, label: str, test_frac: float) -> DataFrame:
    """Quotas from the rows (one aggregate); see ``quotas_from_counts``."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    return quotas_from_counts(c, label, test_frac)


def quotas_from_counts(c: DataFrame, label: str, test_frac: float) -> DataFrame:
    """Per class: n_c, train quota and test quota of a stratified split.

    n_test = ceil(frac * n), n_train = n - n_test; train quotas are
    floor(n_c / n * n_train) plus one for the classes with the largest
    remainders (ties → smaller class value) until they sum to n_train; test
    quota = n_c - train quota. One row per class: the windows below run over
    that tiny table only."""
    w = Window.partitionBy()
    n = F.sum("n_c").over(w)
    c = c.select(label, "n_c", n.alias("_n"))
    c = c.withColumn("_n_test", F.ceil(F.lit(float(test_frac)) * F.col("_n")).cast("long"))
    c = c.withColumn("_n_train", F.col("_n") - F.col("_n_test"))
    cont = F.col("n_c") / F.col("_n") * F.col("_n_train")
    c = c.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont").cast("long"))
    c = c.withColumn("_need", F.col("_n_train") - F.sum("_fl").over(w))
    c = c.withColumn("_rem", F.col("_cont") - F.col("_fl"))
    r = F.row_number().over(Window.partitionBy().orderBy(F.col("_rem").desc(), F.col(label)))
    c = c.withColumn("train_quota", F.col("_fl") + F.when(r <= F.col("_need"), 1).otherwise(0))
    return c.select(label, "n_c", "train_quota",
                    (F.col("n_c") - F.col("train_quota")).alias("test_quota"))


# Selection -----------------------------------------------------------------
def _ordered(df: DataFrame, key: str | Sequence[str], seed: int | str) -> DataFrame:
    """Adds ``_h`` (md5 of seed|key) and ``_tie`` (the key as text, empty for null: null
    keys share one md5)."""
    return df.withColumn("_h", hash_order_key(_key(df, key), seed)) \
             .withColumn("_tie", F.coalesce(_key(df, key).cast("string"), F.lit("")))


def select_first(df: DataFrame, groups: Sequence[str], quotas, key: str | Sequence[str],
                 seed: int | str = 42, out: str = "selected") -> DataFrame:
    """Adds boolean ``out``: whether a row is among the first ``quota`` rows of its group in
    md5(seed|key) order. Exact, and no exchange moves the rows.

    A histogram of hash prefixes per group (one aggregate, map-side combined) shows the
    bucket in which a group's quota runs out; the keys of that bucket alone are counted
    and ordered, which gives the last selected key, the cutoff. Every row is then decided
    by comparing its own key with its group's cutoff, a table of one row per group.

    ``quotas`` maps the group sizes (groups + ``n_c``) to a table of groups + ``quota``; a
    quota of 0 or null selects nothing, one past the group's size all of it. Null group
    values are a group. Where a key is repeated at the cutoff and only some of its rows
    fit, those rows (and no others) are numbered by the hash of the whole row; rows that
    are equal in every column are interchangeable."""
    groups = list(groups)
    own = df.columns
    d = _ordered(df, key, seed)
    b = F.conv(F.substring("_h", 1, auto_hex_digits(df.count())), 16, 10).cast("long")
    d = d.withColumn("_bucket", b)
    counts = d.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n")).cache()
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("n_c"))
    n_groups = sizes.count()
    before = prefix_before(counts, groups, "_bucket", ["_n"], prefix="_before")
    edge = null_safe_join(before, quotas(sizes).select(*groups, "quota"), groups)
    edge = null_safe_join(edge, sizes, groups)
    fits = F.least("quota", "n_c")
    edge = edge.where((F.col("_before_n") < fits) & (fits <= F.col("_before_n") + F.col("_n"))) \
               .select(*groups, "_bucket", (fits - F.col("_before_n")).alias("_left"))
    near = null_safe_join(d.select(*groups, "_bucket", "_h", "_tie"),
                          sized_broadcast(edge, known_rows=n_groups), [*groups, "_bucket"])
    near = near.groupBy(*groups, "_left", "_h", "_tie").agg(F.count(F.lit(1)).alias("_have"))
    w = Window.partitionBy(*groups).orderBy("_h", "_tie")
    near = near.withColumn("_upto", F.sum("_have").over(w))
    cuts = near.where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_have") < F.col("_left"))) \
               .select(*groups, F.struct("_h", "_tie").alias("_cut"),
                       (F.col("_left") - F.col("_upto") + F.col("_have")).alias("_need"), "_have").cache()
    shared = cuts.where(F.col("_need") < F.col("_have")).count()
    counts.unpersist()
    j = null_safe_join(d, sized_broadcast(cuts, known_rows=n_groups), groups, how="left")
    at = F.struct("_h", "_tie")
    if not shared:
        return j.select(*own, F.coalesce(at <= F.col("_cut"), F.lit(False)).alias(out))
    split_key = F.coalesce((at == F.col("_cut")) & (F.col("_need") < F.col("_have")), F.lit(False))
    sure = j.where(~split_key).select(*own, F.coalesce(at <= F.col("_cut"), F.lit(False)).alias(out))
    order = Window.partitionBy(*groups).orderBy(F.xxhash64(*[F.col(c) for c in own]))
    return sure.unionByName(j.where(split_key).withColumn("_r", F.row_number().over(order))
                            .select(*own, (F.col("_r") <= F.col("_need")).alias(out)))


# S1 ------------------------------------------------------------------------
def stratified_holdout(df: DataFrame, label: str, test_frac: float = 0.2,
                       key: str | Sequence[str] = "id", seed: int = 42,
                       split_col: str = "split", names: tuple[str, str] = ("train", "test")
                       ) -> DataFrame:
    """Adds ``split``: exact per-class test sizes (as a stratified 80/20 split
    allocates them); the test rows of a class are its first ``test_quota``
    rows in md5(seed|key) order. Reproducible on any engine with md5; rows stay
    where they are (``select_first``)."""
    def quotas(sizes):
        return quotas_from_counts(sizes, label, test_frac).withColumnRenamed("test_quota", "quota")

    s = select_first(df, [label], quotas, key, seed, "_selected")
    return s.withColumn(split_col, F.when(F.col("_selected"), names[1]).otherwise(names[0])) \
            .drop("_selected")


# S2 ------------------------------------------------------------------------
def train_validation_test(df: DataFrame, label: str, test_frac: float = 0.2,
                          val_frac: float = 0.2, key: str | Sequence[str] = "id",
                          seed: int = 42, split_col: str = "split") -> DataFrame:
    """Nested split: test held out first; validation is then taken from the
    remaining rows with a different salt. The test rows go through the second
    selection as groups of their own with quota 0, so one narrow scan decides both."""
    first = stratified_holdout(df, label, test_frac, key, seed, "_outer", ("rest", "test"))

    def quotas(sizes):
        rest = sizes.where(F.col("_outer") == "rest").drop("_outer")
        q = quotas_from_counts(rest, label, val_frac)
        return q.select(F.lit("rest").alias("_outer"), label, F.col("test_quota").alias("quota"))

    both = select_first(first, ["_outer", label], quotas, key, f"{seed}/validation", "_selected")
    part = F.when(F.col("_outer") == "test", "test") \
            .when(F.col("_selected"), "validation").otherwise("train")
    return both.withColumn(split_col, part).drop("_outer", "_selected")


# S3 ------------------------------------------------------------------------
def stratified_kfold(df: DataFrame, label: str, k: int = 5,
                     key: str | Sequence[str] = "id", seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """Shuffled stratified folds: fold = (rank within class - 1) mod k, rank
    in md5(seed|key) order. Fold sizes per class differ by at most one."""
    d = df.withColumn("_h", hash_order_key(_key(df, key), seed)) \
          .withColumn("_tie", _key(df, key).cast("string"))
    ranked = rank_within(d, [label], "_h", "_tie", out="_rank")
    return ranked.withColumn(fold_col, ((F.col("_rank") - 1) % k).cast("int")) \
                 .drop("_h", "_tie", "_rank")


# S4 ------------------------------------------------------------------------
def fold_bounds(df: DataFrame, label: str, k: int) -> DataFrame:
    """Per class, the cumulative upper rank of each of the k contiguous folds
    (shuffle=False layout): over the label-sorted row list, fold i takes every
    k-th position starting at i, so class c gets
    #{p in [start_c, start_c + n_c) : p mod k = i} rows in fold i."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy().orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_start", F.coalesce(F.sum("n_c").over(w), F.lit(0)))
    c = c.select(label, "n_c", "_start", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"))

    def below(x: Column) -> Column:  # #{0 <= p < x : p mod k == i}
        return F.greatest(F.ceil((x - F.col("_i")) / F.lit(k)), F.lit(0))

    c = c.withColumn("_alloc", below(F.col("_start") + F.col("n_c")) - below(F.col("_start")))
    wi = Window.partitionBy(label).orderBy("_i")
    c = c.withColumn("_upper", F.sum("_alloc").over(wi))
    return c.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_i", "_upper")))
                                .alias("_bounds"))


def kfold_ordered(df: DataFrame, label: str, k: int = 5, key: str = "id",
                  fold_col: str = "fold") -> DataFrame:
    """Unshuffled stratified folds: rows of each class in key order are cut
    into k contiguous blocks of the sizes above."""
    ranked = _rank_by_key(df, label, key)
    b = fold_bounds(df, label, k)
    j = null_safe_join(ranked, sized_broadcast(b), [label])
    fold = F.size(F.filter(F.col("_bounds"), lambda s: s["_upper"] < F.col("_rank")))
    return j.withColumn(fold_col, fold.cast("int")).drop("_rank", "_bounds")


def _rank_by_key(d: DataFrame, label: str, key: str) -> DataFrame:
    """Rank within class in plain key order (two levels: range buckets of the
    key from approximate quantiles, then a window per bucket)."""
    from .ranking import bucketize, prefix_before, range_splits
    numeric = dict(d.dtypes)[key] in ("int", "bigint", "smallint", "tinyint", "double", "float")
    if not numeric:
        raise TypeError("kfold_ordered needs a numeric key column")
    from .ranking import auto_buckets
    n_rows = d.count()
    splits = range_splits(d, key, auto_buckets(n_rows), n_rows=n_rows)
    b = bucketize(d, key, splits, "_kb")
    cnt = b.groupBy(label, "_kb").agg(F.count(F.lit(1)).alias("_n"))
    off = prefix_before(cnt, [label], "_kb", ["_n"], prefix="_off").drop("_n")
    j = null_safe_join(b, sized_broadcast(off), [label, "_kb"])
    w = Window.partitionBy(label, "_kb").orderBy(key)
    return j.withColumn("_rank", F.row_number().over(w) + F.col("_off_n")).drop("_kb", "_off_n")


# S5 ------------------------------------------------------------------------
def shuffle_rank(df: DataFrame, key: str | Sequence[str], seed: int = 42,
                 out: str = "shuffle_rank") -> DataFrame:
    """Full shuffle as a rank column (1..n in md5(seed|key) order), computed
    with the two-level rank; a global sort is only needed for display."""
    d = df.withColumn("_h", hash_order_key(_key(df, key), seed)) \
          .withColumn("_tie", _key(df, key).cast("string")).withColumn("_g", F.lit(0))
    return rank_within(d, ["_g"], "_h", "_tie", out=out).drop("_h", "_tie", "_g")


# S6 / S7 -------------------------------------------------------------------
TOP_N_LIMIT = 1_000


def sample_n(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: the first n in
    md5(seed|key) order. Up to ``TOP_N_LIMIT`` rows it is a top-n (one pass, each
    task hands at most n rows to the merge); beyond, ``select_first`` decides every
    row by the cutoff key where it lies, so no task ever holds the sample."""
    if n <= TOP_N_LIMIT:
        return (df.withColumn("_h", hash_order_key(_key(df, key), seed))
                  .orderBy("_h", _key(df, key).cast("string")).limit(n).drop("_h"))
    d = df.withColumn("_all_rows", F.lit(0))
    s = select_first(d, ["_all_rows"], lambda sizes: sizes.withColumn("quota", F.lit(n).cast("long")),
                     key, seed, "_selected")
    return s.where("_selected").drop("_selected", "_all_rows")


sample_at_most = sample_n
