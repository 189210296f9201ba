"""Profiling operators: quality counts, missing cells,
duplicates, descriptive statistics, class counts, correlations, box-plot
statistics and per-class kernel densities.

Wide statistics are computed as ONE aggregate over the columns (map-side
partial aggregation, a one-row result) and reshaped into long form; only
duplicates and grouped statistics need a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, unpivot_features
from .quantiles import exact_distribution
from .ranking import null_safe_join, sized_broadcast

# Metric names of the quality report, in report order.
QUALITY_METRICS = ["rows", "input_features", "missing_values", "duplicate_rows",
                   "malignant_records", "benign_records"]
# Box-plot whisker reach and density grid defaults.
WHISKER = 1.5
KDE_GRID = 200
KDE_CUT = 3.0


def _missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c.cast("double"))


def _clean(name: str) -> Column:
    """Numeric value with NaN turned into null (pandas ``isna`` semantics)."""
    c = col(name).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# E2 ------------------------------------------------------------------------
def missing_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, missing) per column plus a 'total' row; null and NaN count."""
    wide = df.agg(*[F.count_if(_missing(col(c))).cast("long").alias(c) for c in cols])
    wide = wide.withColumn("total", sum((col(c) for c in cols), F.lit(0)).cast("long"))
    names = [*cols, "total"]
    return wide.unpivot([], [col(c) for c in names], "feature", "missing")


# E3 ------------------------------------------------------------------------
def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row on all ``cols`` (null = null, NaN = NaN):
    sum(count - 1) over groups; one shuffle with map-side counting."""
    cols = list(cols or df.columns)
    g = df.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long")
                 .alias("duplicate_rows"))


# E1 ------------------------------------------------------------------------
def quality_report(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(metric, value): rows, input features, missing cells, duplicate feature
    rows, positives, negatives. One aggregate + the duplicate shuffle."""
    y = F.col(target)
    main = df.agg(
        F.count(F.lit(1)).cast("long").alias("rows"),
        F.lit(len(features)).cast("long").alias("input_features"),
        sum((F.count_if(_missing(col(c))) for c in features), F.lit(0)).cast("long")
        .alias("missing_values"),
        F.count_if(y == 1).cast("long").alias("malignant_records"),
        F.count_if(y == 0).cast("long").alias("benign_records"),
    )
    parts = main.unpivot([], ["rows", "input_features", "missing_values",
                              "malignant_records", "benign_records"], "metric", "value")
    dup = duplicate_rows(df, features).unpivot([], ["duplicate_rows"], "metric", "value")
    order = F.array_position(F.array(*[F.lit(m) for m in QUALITY_METRICS]), F.col("metric"))
    return parts.unionByName(dup).orderBy(order)


# E4 ------------------------------------------------------------------------
STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def describe_features(df: DataFrame, cols: Sequence[str], exact: bool = True,
                      accuracy: int = 10000) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max
    per feature, in long form (one row per feature).

    Moments come from ONE aggregate. Quartiles: ``exact=True`` brackets them by
    a sketch in that aggregate and selects them exactly in a second scan
    (``quantiles.exact_distribution``); ``exact=False`` uses
    ``percentile_approx`` inside the same aggregate (relative rank error
    1/accuracy)."""
    if exact:
        return _exact_describe(df, cols, accuracy)
    aggs = []
    for i, c in enumerate(cols):
        x = _clean(c)
        parts = [F.lit(c).alias("feature"),
                 F.count(x).cast("long").alias("count"), F.avg(x).alias("mean"),
                 F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
        if not exact:
            parts.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias("_p"))
        aggs.append(F.struct(*parts).alias(f"_s{i}"))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(cols))])).alias("s"))
    return long.select(
            "s.feature", "s.count", "s.mean", "s.std", "s.min",
            F.col("s._p")[0].cast("double").alias("p25"), F.col("s._p")[1].cast("double").alias("p50"),
            F.col("s._p")[2].cast("double").alias("p75"), "s.max")


def _exact_describe(df: DataFrame, cols: Sequence[str], accuracy: int) -> DataFrame:
    stats, _ = exact_distribution(df, cols, [], [0.25, 0.5, 0.75], accuracy)
    return stats.select("feature", F.col("n").alias("count"), "mean", "std", "min", F.col("q")[0].alias("p25"),
                        F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


# E5 ------------------------------------------------------------------------
def class_counts(df: DataFrame, column: str) -> DataFrame:
    """value_counts: (value, count) ordered by count desc, value asc."""
    return (df.groupBy(col(column).alias("value"))
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col("value")))


# E6 ------------------------------------------------------------------------
def correlation_matrix(df: DataFrame, cols: Sequence[str], batch: int = 100) -> DataFrame:
    """Pearson correlation of every ordered pair (feature_a, feature_b) with
    pairwise-complete rows (null pairs skipped, NaN treated as null).

    The upper triangle is computed as batched pair aggregates (<= ``batch``
    ``corr`` per job, each job one pass with map-side partial states) and
    mirrored; the diagonal is corr(x, x)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    clean = df.select(*[_clean(c).alias(c) for c in cols])
    parts = []
    for k in range(0, len(pairs), batch):
        chunk = pairs[k:k + batch]
        wide = clean.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                    F.corr(col(a), col(b)).alias("r")).alias(f"_c{j}")
                           for j, (a, b) in enumerate(chunk)])
        parts.append(wide.select(F.explode(F.array(*[F.col(f"_c{j}")
                                                     for j in range(len(chunk))])).alias("p"))
                         .select("p.a", "p.b", "p.r"))
    tri = parts[0]
    for p in parts[1:]:
        tri = tri.unionByName(p)
    mirrored = tri.where(F.col("a") != F.col("b")).select(
        F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return tri.unionByName(mirrored).select(
        F.col("a").alias("feature_a"), F.col("b").alias("feature_b"),
        F.col("r").alias("correlation"))


# E7 ------------------------------------------------------------------------
def target_correlations(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """corr(feature, target) per feature, ordered by |corr| desc (one agg)."""
    y = F.col(target).cast("double")
    wide = df.agg(*[F.struct(F.lit(c).alias("feature"), F.corr(_clean(c), y).alias("r"))
                    .alias(f"_t{i}") for i, c in enumerate(cols)])
    long = wide.select(F.explode(F.array(*[F.col(f"_t{i}") for i in range(len(cols))])).alias("t"))
    return (long.select(F.col("t.feature").alias("feature"),
                        F.col("t.r").alias("correlation_with_target"))
                .orderBy(F.abs("correlation_with_target").desc_nulls_last(), "feature"))


# E8 ------------------------------------------------------------------------
def boxplot_stats(df: DataFrame, cols: Sequence[str], by: str, exact: bool = True,
                  accuracy: int = 10000) -> DataFrame:
    """Per (class, feature): quartiles (linear interpolation), 1.5·IQR fences,
    whiskers = most extreme values inside the fences, outlier count."""
    long = unpivot_features(df, [by], cols).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    keys = [by, "feature"]
    if exact:
        from .ranking import exact_quantiles
        q = exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75])
        qs = q.select(*keys, "n", F.col("q0").alias("q1"),
                      F.col("q1").alias("median"), F.col("q2").alias("q3"))
    else:
        pct = F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy)
        qs = long.groupBy(*keys).agg(pct.alias("_q"), F.count(F.lit(1)).alias("n"))
        qs = qs.select(*keys, "n", F.col("_q")[0].cast("double").alias("q1"),
                       F.col("_q")[1].cast("double").alias("median"),
                       F.col("_q")[2].cast("double").alias("q3"))
    # one row per (class, feature), read twice (fences, output): keep it
    qs = qs.cache()
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1")) \
           .withColumn("lo_fence", F.col("q1") - F.col("iqr") * WHISKER) \
           .withColumn("hi_fence", F.col("q3") + F.col("iqr") * WHISKER)
    # one row per (class, feature): bounded by classes x features, size-checked
    j = null_safe_join(long, sized_broadcast(qs.select(*keys, "lo_fence", "hi_fence")), keys)
    v = F.col("value")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    w = j.groupBy(*keys).agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).cast("long").alias("outliers"))
    return null_safe_join(qs, w, keys).select(
        *keys, "n", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "outliers")


# E9 ------------------------------------------------------------------------
def kde(df: DataFrame, cols: Sequence[str], by: str, grid_n: int = KDE_GRID,
        cut: float = KDE_CUT, bw_adjust: float = 1.0, bins: int | None = None) -> DataFrame:
    """Gaussian kernel density per (class, feature), each normalised on its
    own: bandwidth h = std_samp * n^(-1/5) * bw_adjust (Scott), evaluated on
    ``grid_n`` points from min - cut*h to max + cut*h.

    Exact: data are first reduced to distinct (class, feature, value, count);
    each distinct value then adds its kernel to the grid points of its group
    (explode of the grid inside the task) and the sums are partially
    aggregated before the shuffle, so the shuffle carries at most grid_n rows
    per group per task.

    ``bins``: for very high-cardinality columns, values are first snapped to
    the centres of ``bins`` equal-width bins per group (counts kept), which
    bounds the kernel work at bins x grid_n per group (an approximation with
    error below half a bin width in x; off by default)."""
    long = unpivot_features(df, [by], cols).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    keys = [by, "feature"]
    st = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 F.stddev_samp("value").alias("sd"),
                                 F.min("value").alias("lo"), F.max("value").alias("hi"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
                       * F.lit(bw_adjust)).where(F.col("h") > 0)
    st = st.withColumn("g0", F.col("lo") - F.col("h") * cut) \
           .withColumn("step", (F.col("hi") - F.col("lo") + F.col("h") * (2 * cut))
                       / F.lit(grid_n - 1))
    if bins:
        rng = st.select(*keys, "lo", ((F.col("hi") - F.col("lo")) / bins).alias("_bw"))
        long = null_safe_join(long, sized_broadcast(rng), keys).select(
            *keys, F.when(F.col("_bw") > 0, F.col("lo") + (F.least(
                F.floor((F.col("value") - F.col("lo")) / F.col("_bw")), F.lit(bins - 1)) + 0.5)
                * F.col("_bw")).otherwise(F.col("value")).alias("value"))
    distinct = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    j = null_safe_join(distinct, sized_broadcast(st.select(*keys, "n", "h", "g0", "step")), keys)
    j = j.select(*keys, "value", "c", "n", "h", "g0", "step",
                 F.explode(F.sequence(F.lit(0), F.lit(grid_n - 1))).alias("i"))
    x = F.col("g0") + F.col("step") * F.col("i")
    z = (x - F.col("value")) / F.col("h")
    contrib = F.col("c") * F.exp(z * z * -0.5)
    dens = j.groupBy(*keys, "i").agg(
        F.first(x).alias("x"), F.sum(contrib).alias("_s"),
        F.first("n").alias("n"), F.first("h").alias("h"))
    norm = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return dens.select(*keys, F.col("i").alias("grid_index"), "x",
                       (F.col("_s") / norm).alias("density"))


# E10 -----------------------------------------------------------------------
def compare_tables(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Side-by-side describe of two tables (feature, stat, value_a, value_b),
    plus shape rows, missing cells and duplicate rows of both."""
    def long(d: DataFrame, tag: str) -> DataFrame:
        desc = describe_features(d, cols).select(
            "feature", F.col("count").cast("double").alias("count"), *STATS[1:])
        st = desc.unpivot(["feature"], STATS, "stat", tag)
        shape = d.agg(F.count(F.lit(1)).cast("double").alias("rows"),
                      F.lit(float(len(d.columns))).alias("columns"),
                      sum((F.count_if(_missing(col(c))) for c in cols), F.lit(0))
                      .cast("double").alias("missing_values"))
        shape = shape.unpivot([], ["rows", "columns", "missing_values"], "stat", tag) \
                     .withColumn("feature", F.lit("__table__"))
        dup = duplicate_rows(d, cols).select(F.col("duplicate_rows").cast("double").alias(tag)) \
            .withColumn("stat", F.lit("duplicate_rows")).withColumn("feature", F.lit("__table__"))
        return st.unionByName(shape).unionByName(dup)
    return long(a, "value_a").join(long(b, "value_b"), ["feature", "stat"], "full")


# E11 -----------------------------------------------------------------------
def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long")
                  .alias("columns"))
