"""Evaluation operators.

Confusion counts are one map-side-combined aggregate; ROC-AUC and the ROC
curve are exact (Mann-Whitney with half credit for ties) via a two-level
prefix sum over distinct scores; the threshold sweep is one pass over the
rows regardless of the grid length (rows are bucketed to the highest grid
point they reach, never multiplied by the grid).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import arange, fbeta, safe_ratio
from .ranking import (ALL, bucketize, null_safe_join, prefix_before, sized_broadcast,
                      two_level_prefix, with_all_group)

# The two threshold grids (start, stop, step).
GRID_05 = (0.20, 0.81, 0.05)
GRID_01 = (0.10, 0.91, 0.01)


def _drop_all(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.drop(ALL) if (ALL in df.columns and ALL not in by) else df


# E12 -----------------------------------------------------------------------
def confusion(df: DataFrame, label: str = "label", pred: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp with the fixed label order [0, 1] (one aggregate)."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
        F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
        F.count_if((y == 1) & (p == 1)).cast("long").alias("tp"),
    )


# E13 -----------------------------------------------------------------------
def metric_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> list[Column]:
    """accuracy, precision, recall, f1, specificity, false_negative_rate from
    the four counts; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(x) for x in (tn, fp, fn, tp))
    return [
        safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
        safe_ratio(tn, tn + fp).alias("specificity"),
        safe_ratio(fn, fn + tp).alias("false_negative_rate"),
    ]


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                           by: Sequence[str] = ()) -> DataFrame:
    c = confusion(df, label, pred, by)
    return c.select(*by, "tn", "fp", "fn", "tp", *metric_columns())


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float,
                      by: Sequence[str] = ()) -> DataFrame:
    """E13 at a fixed threshold (prediction = score >= threshold). Rows whose score is
    missing (null or NaN) have no prediction and are in none of the counts, as in the
    sweep and the ROC operators."""
    d = df.withColumn("_pred", F.when(has_score(score), (F.col(score) >= F.lit(threshold)).cast("int")))
    return classification_metrics(d, label, "_pred", by)


# E15 / E16 -----------------------------------------------------------------
def has_score(score: str) -> Column:
    """Whether a row has a score: neither null nor NaN."""
    return F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))


def _score_counts(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Distinct (group, score) with positive / negative counts; rows with a
    null label or a missing score (null or NaN) are left out. One pass over the rows with map-side
    combine; the result is persisted (memory, spilling to disk) because the
    quantile, offset and final steps all read it."""
    from pyspark import StorageLevel
    y = F.col(label)
    return (df.where(y.isNotNull() & has_score(score))
              .groupBy(*by, score)
              .agg(F.count_if(y == 1).cast("long").alias("pos"),
                   F.count_if(y != 1).cast("long").alias("neg"))
              .persist(StorageLevel.MEMORY_AND_DISK))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            by: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group; ties get half credit.

    AUC = sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N), summed in
    DECIMAL(38,0) as 2*pos*neg_below + pos*neg so no precision is lost at any
    row count. A group with only one class gives null."""
    d, g = with_all_group(df, by)
    sc = _score_counts(d, label, score, g)
    return _drop_all(_auc_from_counts(sc, g, score, n_buckets), by)


def _n_groups(sc: DataFrame, g: list[str]) -> int:
    """Number of groups: 1 for the global form, else one count of the small
    per-group table (it bounds every per-(group, bucket) table below)."""
    if g == [ALL]:
        return 1
    return sc.select(*g).distinct().count()


def _auc_from_counts(sc: DataFrame, g: list[str], score: str, n_buckets: int | None,
                     n_groups: int | None = None) -> DataFrame:
    ng = n_groups if n_groups is not None else _n_groups(sc, g)
    pre = two_level_prefix(sc, g, score, ["neg"], n_buckets=n_buckets, n_groups=ng)
    dec = "decimal(38,0)"
    pos, neg, nb = (F.col(c).cast(dec) for c in ("pos", "neg", "before_neg"))
    agg = pre.groupBy(*g).agg(
        F.sum(pos * nb * 2 + pos * neg).alias("_u2"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    auc = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(None).cast("double")) \
           .otherwise(F.col("_u2").cast("double") /
                      (F.col("_p").cast("double") * F.col("_n").cast("double") * 2.0))
    return agg.select(*g, auc.alias("roc_auc"))


def score_outcomes(df: DataFrame, label: str, score: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Persisted counts per (group, score, prediction): rows of class 1 (pos), of class 0
    (zero) and of any other class than 1 (neg). A scored table goes through here once;
    ``outcome_metrics`` reads both the confusion counts and the ROC-AUC from it."""
    from pyspark import StorageLevel
    y = F.col(label)
    return df.groupBy(*by, score, pred).agg(F.count_if(y == 1).cast("long").alias("pos"), F.count_if(y == 0).cast("long").alias("zero"),
                                            F.count_if(y != 1).cast("long").alias("neg")).persist(StorageLevel.MEMORY_AND_DISK)


def outcome_metrics(counts: DataFrame, score: str, pred: str, by: Sequence[str]) -> DataFrame:
    """``classification_metrics`` joined with ``roc_auc`` per group, from ``score_outcomes``."""
    by = list(by)

    def total(p: int, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(pred) == p, F.col(c))), F.lit(0)).cast("long")

    m = counts.groupBy(*by).agg(total(0, "zero").alias("tn"), total(1, "zero").alias("fp"),
                                total(0, "pos").alias("fn"), total(1, "pos").alias("tp"))
    m = m.select(*by, "tn", "fp", "fn", "tp", *metric_columns())
    sc = counts.where(has_score(score) & (F.col("pos") + F.col("neg") > 0)).select(*by, score, "pos", "neg")
    return m.join(_auc_from_counts(sc, by, score, None), by)


def threshold_metrics_and_auc(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str]) -> DataFrame:
    """``threshold_metrics`` joined with ``roc_auc``; the scores are taken once."""
    d = df.withColumn("_pred", F.when(has_score(score), (F.col(score) >= F.lit(threshold)).cast("int")))
    return outcome_metrics(score_outcomes(d, label, score, "_pred", by), score, "_pred", by)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              by: Sequence[str] = (), n_buckets: int | None = None,
              drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr): rates of rows with score >= threshold at each
    distinct score, plus the origin point (threshold +inf, 0, 0).

    ``drop_intermediate`` keeps, besides the highest and lowest score, only
    points where the curve changes slope: walking scores downwards, a point is
    dropped when the next lower score adds exactly the same (pos, neg) counts
    as it did. The neighbour of the lowest score of a range bucket is found
    in a small per-bucket table, so no global window is needed."""
    from pyspark.sql import Window
    d, g = with_all_group(df, by)
    sc = _score_counts(d, label, score, g)
    n_sc = sc.count()  # distinct (group, score) rows; also materialises the cache
    from .ranking import auto_buckets
    splits = range_splits_for(sc, score, n_buckets or auto_buckets(n_sc), n_sc)
    ng = _n_groups(sc, g)
    bound = ng * (len(splits) - 1)  # rows of any per-(group, bucket) table
    b = bucketize(sc, score, splits, "_rb")
    off = prefix_before(
        b.groupBy(*g, "_rb").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")),
        g, "_rb", ["pos", "neg"], prefix="_off_").drop("pos", "neg")
    j = null_safe_join(b, sized_broadcast(off, known_rows=bound), [*g, "_rb"])
    w = Window.partitionBy(*g, "_rb").orderBy(score)
    wc = w.rowsBetween(Window.unboundedPreceding, -1)
    j = j.select(*g, score, "pos", "neg", "_rb",
                 (F.col("_off_pos") + F.coalesce(F.sum("pos").over(wc), F.lit(0))).alias("before_pos"),
                 (F.col("_off_neg") + F.coalesce(F.sum("neg").over(wc), F.lit(0))).alias("before_neg"),
                 F.lag(F.struct("pos", "neg")).over(w).alias("_lower"))
    # counts of the next lower distinct score for the lowest score of a bucket:
    # the highest score of the previous non-empty bucket (small table)
    last = b.groupBy(*g, "_rb").agg(F.max_by(F.struct("pos", "neg"), F.col(score)).alias("_last"),
                                    F.max(score).alias("_bmax"))
    wl = Window.partitionBy(*g).orderBy("_rb")
    edge = last.select(*g, "_rb", F.lag("_last").over(wl).alias("_prev_last"), "_bmax")
    top = last.groupBy(*g).agg(F.max("_bmax").alias("_top"))
    j = null_safe_join(j, sized_broadcast(edge.drop("_bmax"), known_rows=bound), [*g, "_rb"])
    j = null_safe_join(j, sized_broadcast(top, known_rows=ng), g)
    lower = F.coalesce(F.col("_lower"), F.col("_prev_last"))
    totals = sc.groupBy(*g).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = null_safe_join(j, sized_broadcast(totals, known_rows=ng), g)
    keep = (lower.isNull() | (F.col(score) == F.col("_top")) |
            (lower["pos"] != F.col("pos")) | (lower["neg"] != F.col("neg")))
    if drop_intermediate:
        j = j.where(keep)
    pts = j.select(
        *g, F.col(score).cast("double").alias("threshold"),
        safe_ratio(F.col("_N") - F.col("before_neg"), F.col("_N")).alias("fpr"),
        safe_ratio(F.col("_P") - F.col("before_pos"), F.col("_P")).alias("tpr"))
    origin = totals.select(*g, F.lit(float("inf")).alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _drop_all(pts.unionByName(origin), by)


def range_splits_for(sc: DataFrame, score: str, n_buckets: int,
                     n_rows: int | None = None) -> list[float]:
    from .ranking import range_splits
    return range_splits(sc, score, n_buckets, n_rows=n_rows)


# H1 ------------------------------------------------------------------------
def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score",
                    grid: Sequence[float] | None = None, by: Sequence[str] = (),
                    with_auc: bool = True) -> DataFrame:
    """Full metric row for every grid threshold (prediction = score >= t) in
    one pass over the rows.

    Each row goes to bucket b = number of grid points <= score (binary search),
    so it is predicted positive exactly at thresholds t_i with i < b. The pass
    ends in ``groupBy(group, bucket)`` (at most len(grid)+1 rows per group, combined
    before the exchange, so nothing is exchanged or kept by score); counts per
    threshold are reverse running sums over that small table. ``with_auc`` adds the
    exact ROC-AUC, which needs the distinct scores; these are then counted once and
    serve both. Rows with a null label or a missing score (null or NaN) are left out."""
    grid = list(grid if grid is not None else arange(*GRID_05))
    if sorted(grid) != grid or len(set(grid)) != len(grid):
        raise ValueError("grid must be strictly increasing")
    d, g = with_all_group(df, by)
    splits = [float("-inf"), *grid, float("inf")]
    if with_auc:
        sc = _score_counts(d, label, score, g)
        pos, neg = F.sum("pos"), F.sum("neg")
    else:
        sc = d.where(F.col(label).isNotNull() & has_score(score)).select(*g, label, score)
        pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)
    counts = bucketize(sc, score, splits, "_bucket").groupBy(*g, "_bucket") \
        .agg(pos.cast("long").alias("pos"), neg.cast("long").alias("neg"))
    # Grid points per group: the grid is a parameter (bounded), exploded from a
    # literal array next to each distinct group; no join with the rows.
    groups = counts.select(*g).distinct()
    frame = groups.select(*g, F.posexplode(F.array(*[F.lit(float(t)) for t in grid]))
                          .alias("_i", "threshold"))
    frame = frame.withColumn("_bucket", F.col("_i") + 1)
    j = null_safe_join(frame, counts, [*g, "_bucket"], how="left").fillna(0, ["pos", "neg"])
    wdesc = (Window.partitionBy(*g).orderBy(F.col("_i").desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tot = counts.groupBy(*g).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = j.select(*g, "_i", "threshold",
                 F.sum("pos").over(wdesc).alias("tp"), F.sum("neg").over(wdesc).alias("fp"))
    j = null_safe_join(j, tot, g)
    j = j.select(*g, "_i", "threshold", "tp", "fp",
                 (F.col("_P") - F.col("tp")).alias("fn"),
                 (F.col("_N") - F.col("fp")).alias("tn"))
    out = j.select(*g, "_i", "threshold", "tn", "fp", "fn", "tp", *metric_columns())
    if with_auc:
        out = null_safe_join(out, _auc_from_counts(sc, g, score, None), g, how="left")
    return _drop_all(out.orderBy(*g, "_i").drop("_i"), by)


def naive_threshold_sweep(df: DataFrame, label: str, score: str,
                          grid: Sequence[float]) -> DataFrame:
    """Reference implementation for tests only: one aggregate per grid point
    (len(grid) passes)."""
    parts = []
    for t in grid:
        m = threshold_metrics(df, label, score, t)
        parts.append(m.select(F.lit(float(t)).alias("threshold"), *m.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# E14 -----------------------------------------------------------------------
def with_fbeta(df: DataFrame, beta: float = 2.0, precision: str = "precision",
               recall: str = "recall", out: str | None = None) -> DataFrame:
    name = out or f"f{int(beta) if float(beta).is_integer() else beta}"
    return df.withColumn(name, fbeta(precision, recall, beta))


# E17 -----------------------------------------------------------------------
def cv_summary(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std (ddof 0) of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return folds.groupBy(*by).agg(*aggs)


# E18 -----------------------------------------------------------------------
def split_report(df: DataFrame, split_col: str = "split", label: str = "label") -> DataFrame:
    y = F.col(label)
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(y == 1).cast("long").alias("positives"),
        F.count_if(y == 0).cast("long").alias("negatives"))


# E19 -----------------------------------------------------------------------
def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """'balanced' weights n / (k * n_c) per class (one small table)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()  # tiny: one row per class
    return c.select(label, "n_c",
                    (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                    .alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach the balanced weight; the class table has one row per label value
    and is broadcast after a size check."""
    cw = class_weights(df, label).select(label, F.col("weight").alias(out))
    return null_safe_join(df, sized_broadcast(cw), [label], how="left")


# H2 ------------------------------------------------------------------------
def union_tables(a: DataFrame, b: DataFrame, origin: str | None = "origin",
                 names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Concatenate by column name; missing columns are null."""
    if origin:
        a = a.withColumn(origin, F.lit(names[0]))
        b = b.withColumn(origin, F.lit(names[1]))
    return a.unionByName(b, allowMissingColumns=True)


# H4 ------------------------------------------------------------------------
def split_overlap(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct feature rows present in both splits (leakage guard)."""
    return train.select(*cols).intersect(test.select(*cols))
