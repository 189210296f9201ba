"""Profile queries (build step 2) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.columns import unpivot_features
from ..operators import profile as P
from .catalog import register
from .inputs import FEATURES, LABELLED_SQL, labelled, table

# Nulls for missing-value tests: l_tax = 0 becomes null.
_NULLED_SQL = ("d AS (SELECT case_key, l_quantity, l_extendedprice, l_discount, "
               "nullif(l_tax, 0.0) AS l_tax, label, score, l_linestatus FROM lab)")


def _nulled(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return lab.withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))


def _miss(c):
    return f"count_if({c} IS NULL OR isnan({c}))"


@register("quality_report", f"""
WITH {LABELLED_SQL}, {_NULLED_SQL}
SELECT 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM d
UNION ALL SELECT 'input_features', CAST(4 AS BIGINT)
UNION ALL SELECT 'missing_values', CAST({' + '.join(_miss(c) for c in FEATURES)} AS BIGINT) FROM d
UNION ALL SELECT 'duplicate_rows', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
  FROM (SELECT count(*) AS n FROM d GROUP BY {', '.join(FEATURES)})
UNION ALL SELECT 'malignant_records', CAST(count_if(label = 1) AS BIGINT) FROM d
UNION ALL SELECT 'benign_records', CAST(count_if(label = 0) AS BIGINT) FROM d""")
def quality_report_q(spark, sf_dir):
    """E1 on labelled lineitem with zero tax turned into nulls."""
    return P.quality_report(_nulled(spark, sf_dir), "label", FEATURES)


@register("missing_cells", f"""
WITH {LABELLED_SQL}, {_NULLED_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({_miss(c)} AS BIGINT) AS missing FROM d" for c in FEATURES)}
UNION ALL SELECT 'total', CAST({' + '.join(_miss(c) for c in FEATURES)} AS BIGINT) FROM d""")
def missing_cells_q(spark, sf_dir):
    """Per-column and total missing cells (null or NaN)."""
    return P.missing_cells(_nulled(spark, sf_dir), FEATURES)


@register("duplicate_rows", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM labels GROUP BY quality, toxic)""")
def duplicate_rows_q(spark, sf_dir):
    """E3 on the labels table projected without its id (many duplicates)."""
    return P.duplicate_rows(table(spark, sf_dir, "labels").select("quality", "toxic"))


@register("duplicate_rows_lineitem", f"""
WITH {LABELLED_SQL}
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lab GROUP BY {', '.join(FEATURES)}, label)""")
def duplicate_rows_lineitem_q(spark, sf_dir):
    """E3 on the four features and the label of lineitem."""
    return P.duplicate_rows(labelled(spark, sf_dir).select(*FEATURES, "label"))


def _describe_sql(src="lab", pre=LABELLED_SQL):
    parts = []
    for c in FEATURES:
        x = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
        parts.append(
            f"SELECT '{c}' AS feature, CAST(count({x}) AS BIGINT) AS count, avg({x}) AS mean, "
            f"stddev_samp({x}) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS p25, "
            f"quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, max({x}) AS max "
            f"FROM {src}")
    return f"WITH {pre}\n" + "\nUNION ALL ".join(parts)


@register("describe_features", _describe_sql())
def describe_features_q(spark, sf_dir):
    """Count, mean, sample std, min, quartiles, max per feature."""
    return P.describe_features(labelled(spark, sf_dir), FEATURES)


@register("class_counts", """
SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type""")
def class_counts_q(spark, sf_dir):
    """E5 on events.event_type."""
    return P.class_counts(table(spark, sf_dir, "events"), "event_type")


@register("class_counts_segment", """
SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY c_mktsegment""")
def class_counts_segment_q(spark, sf_dir):
    """E5 on customer.c_mktsegment."""
    return P.class_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@register("unpivot_features", f"""
WITH {LABELLED_SQL}
{' UNION ALL '.join(f"SELECT case_key, label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lab" for c in FEATURES)}""")
def unpivot_features_q(spark, sf_dir):
    """Melt the four features to (case_key, label, feature, value)."""
    return unpivot_features(labelled(spark, sf_dir), ["case_key", "label"], FEATURES)


@register("correlation_matrix", f"""
WITH {LABELLED_SQL}
{' UNION ALL '.join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation FROM lab" for a in FEATURES for b in FEATURES)}""")
def correlation_matrix_q(spark, sf_dir):
    """Pearson correlation of every feature pair, long form."""
    return P.correlation_matrix(labelled(spark, sf_dir), FEATURES)


@register("target_correlations", f"""
WITH {LABELLED_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, CAST(label AS DOUBLE)) AS correlation_with_target FROM lab" for c in FEATURES)}""")
def target_correlations_q(spark, sf_dir):
    """Correlation of each feature with the label, by |corr| desc."""
    return P.target_correlations(labelled(spark, sf_dir), "label", FEATURES)


_LONG_SQL = "lng AS (" + " UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lab" for c in FEATURES) + ")"


@register("boxplot_stats", f"""
WITH {LABELLED_SQL}, {_LONG_SQL},
qs AS (SELECT label, feature, count(*) AS n, quantile_cont(value, 0.25) AS q1,
              quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
       FROM lng GROUP BY label, feature),
f AS (SELECT *, q3 - q1 AS iqr, q1 - (q3 - q1) * 1.5 AS lo_fence, q3 + (q3 - q1) * 1.5 AS hi_fence FROM qs)
SELECT f.label, f.feature, n, q1, median, q3, iqr,
       min(CASE WHEN value >= lo_fence AND value <= hi_fence THEN value END) AS whisker_low,
       max(CASE WHEN value >= lo_fence AND value <= hi_fence THEN value END) AS whisker_high,
       CAST(count_if(NOT (value >= lo_fence AND value <= hi_fence)) AS BIGINT) AS outliers
FROM f JOIN lng ON f.label = lng.label AND f.feature = lng.feature
GROUP BY f.label, f.feature, n, q1, median, q3, iqr""")
def boxplot_stats_q(spark, sf_dir):
    """Quartiles, whiskers and outliers per (label, feature)."""
    return P.boxplot_stats(labelled(spark, sf_dir), FEATURES, "label")


_KDE_FEATURES = ["l_discount", "l_tax"]


@register("kde", f"""
WITH {LABELLED_SQL},
lng AS ({' UNION ALL '.join(f"SELECT label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lab" for c in _KDE_FEATURES)}),
st AS (SELECT label, feature, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
       FROM lng GROUP BY label, feature),
st2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) * 1.0 AS h FROM st),
st3 AS (SELECT *, lo - h * 3.0 AS g0, (hi - lo + h * 6.0) / 199 AS step FROM st2 WHERE h > 0),
dv AS (SELECT label, feature, value, count(*) AS c FROM lng GROUP BY label, feature, value),
g AS (SELECT st3.*, t.i, g0 + step * t.i AS x FROM st3, range(0, 200) t(i))
SELECT g.label, g.feature, CAST(g.i AS INTEGER) AS grid_index, g.x,
       sum(c * exp(((g.x - value) / h) * ((g.x - value) / h) * -0.5))
         / (n * h * {repr(float(__import__('math').sqrt(2 * __import__('math').pi)))}) AS density
FROM g JOIN dv ON g.label = dv.label AND g.feature = dv.feature
GROUP BY g.label, g.feature, g.i, g.x, n, h""")
def kde_q(spark, sf_dir):
    """Per-label Gaussian densities of discount and tax on 200 points."""
    return P.kde(labelled(spark, sf_dir), _KDE_FEATURES, "label")


def _cmp_sql():
    def side(cond, tag):
        desc = []
        for c in FEATURES:
            x = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
            stats = {
                "count": f"CAST(count({x}) AS DOUBLE)", "mean": f"avg({x})", "std": f"stddev_samp({x})",
                "min": f"min({x})", "p25": f"quantile_cont({x}, 0.25)", "p50": f"quantile_cont({x}, 0.5)",
                "p75": f"quantile_cont({x}, 0.75)", "max": f"max({x})"}
            for s, e in stats.items():
                desc.append(f"SELECT '{c}' AS feature, '{s}' AS stat, {e} AS {tag} FROM lab WHERE {cond}")
        miss = " + ".join(_miss(c) for c in FEATURES)
        desc.append(f"SELECT '__table__', 'rows', CAST(count(*) AS DOUBLE) FROM lab WHERE {cond}")
        desc.append(f"SELECT '__table__', 'columns', 7.0")
        desc.append(f"SELECT '__table__', 'missing_values', CAST({miss} AS DOUBLE) FROM lab WHERE {cond}")
        desc.append(f"SELECT '__table__', 'duplicate_rows', CAST(coalesce(sum(n - 1), 0) AS DOUBLE) "
                    f"FROM (SELECT count(*) AS n FROM lab WHERE {cond} GROUP BY {', '.join(FEATURES)})")
        return " UNION ALL ".join(desc)
    return (f"WITH {LABELLED_SQL}, a AS ({side(chr(39).join(['l_linestatus = ', 'O', '']), 'value_a')}), "
            f"b AS ({side(chr(39).join(['l_linestatus = ', 'F', '']), 'value_b')})\n"
            "SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.stat, b.stat) AS stat, value_a, value_b "
            "FROM a FULL JOIN b ON a.feature = b.feature AND a.stat = b.stat")


@register("compare_tables", _cmp_sql())
def compare_tables_q(spark, sf_dir):
    """Open vs filled line items, describe + shape + missing + duplicates."""
    lab = labelled(spark, sf_dir).drop("l_linestatus")
    li = labelled(spark, sf_dir)
    a = li.where(F.col("l_linestatus") == "O").select(*lab.columns)
    b = li.where(F.col("l_linestatus") == "F").select(*lab.columns)
    return P.compare_tables(a, b, FEATURES)


@register("clean_target", f"""
WITH {LABELLED_SQL}
SELECT CAST(least(greatest(round_even(l_quantity / 20.0 - 0.5, 0), 0), 1) AS INTEGER) AS target,
       count(*) AS records
FROM lab GROUP BY 1""")
def clean_target_q(spark, sf_dir):
    """Round half-even, clip to [0, 1], int — quantity/20 - 0.5 has exact
    .5 ties (q = 20 → 0.5 → 0; q = 40 → 1.5 → 2 → 1)."""
    lab = labelled(spark, sf_dir)
    raw = F.col("l_quantity") / 20.0 - 0.5
    return (lab.select(S.clean_target(raw).alias("target"))
               .groupBy("target").agg(F.count(F.lit(1)).alias("records")))


@register("decode_label", """
SELECT CASE WHEN quality = 1 THEN 'Malignant' WHEN quality = 0 THEN 'Benign' END AS diagnosis,
       count(*) AS records
FROM labels GROUP BY 1""")
def decode_label_q(spark, sf_dir):
    """1/0 → names (unmapped → null), counted."""
    lab = table(spark, sf_dir, "labels")
    return (lab.select(S.decode_label("quality").alias("diagnosis"))
               .groupBy("diagnosis").agg(F.count(F.lit(1)).alias("records")))


@register("shape", f"""
WITH {LABELLED_SQL} SELECT count(*) AS rows, CAST(8 AS BIGINT) AS columns FROM lab""")
def shape_q(spark, sf_dir):
    """Rows and columns of the labelled table."""
    return P.shape(labelled(spark, sf_dir))
