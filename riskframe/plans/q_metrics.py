"""Queries for confusion, metrics, ROC and threshold sweeps (steps 1 and 4)."""

from __future__ import annotations

from ..functions.scalars import arange
from ..operators import metrics as M
from .catalog import register
from .inputs import LABELLED_SQL, SCORED_MODELS_SQL, labelled, scored_models


def _grid_sql(grid) -> str:
    vals = ", ".join(repr(float(t)) for t in grid)
    return f"grid AS (SELECT unnest([{vals}]::DOUBLE[]) AS threshold)"


_METRICS_SQL = """
  CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
  CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity,
  CASE WHEN fn + tp = 0 THEN 0.0 ELSE fn / (fn + tp) END AS false_negative_rate"""

_CONF_SQL = """
  CAST(count_if(label = 0 AND score < {t}) AS BIGINT) AS tn,
  CAST(count_if(label = 0 AND score >= {t}) AS BIGINT) AS fp,
  CAST(count_if(label = 1 AND score < {t}) AS BIGINT) AS fn,
  CAST(count_if(label = 1 AND score >= {t}) AS BIGINT) AS tp"""


@register("confusion_metrics", f"""
WITH {LABELLED_SQL}, c AS (SELECT {_CONF_SQL.format(t='0.5')} FROM lab)
SELECT tn, fp, fn, tp, {_METRICS_SQL} FROM c""")
def confusion_metrics(spark, sf_dir):
    """E12+E13: labelled lineitem, prediction = score >= 0.5, one metrics row."""
    lab = labelled(spark, sf_dir)
    return M.threshold_metrics(lab, "label", "score", 0.5)


@register("metrics_by_model", f"""
WITH {SCORED_MODELS_SQL}, c AS (SELECT model, {_CONF_SQL.format(t='0.5')} FROM sm GROUP BY model)
SELECT model, tn, fp, fn, tp, {_METRICS_SQL} FROM c""")
def metrics_by_model(spark, sf_dir):
    """E12+E13 grouped: confusion and metrics per model at 0.5."""
    return M.threshold_metrics(scored_models(spark, sf_dir), "label", "score", 0.5, by=["model"])


_AUC_SQL = """
s AS (SELECT {g} score, CAST(count_if(label = 1) AS HUGEINT) AS pos,
             CAST(count_if(label <> 1) AS HUGEINT) AS neg
      FROM {src} WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY {g} score),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {pg} ORDER BY score
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM s),
a AS (SELECT {g} CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL
             ELSE CAST(sum(2 * pos * nb + pos * neg) AS DOUBLE)
                  / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2.0) END AS roc_auc
      FROM c GROUP BY ALL)"""


@register("roc_auc", f"""
WITH {LABELLED_SQL}, {_AUC_SQL.format(g='', pg='1', src='lab')}
SELECT roc_auc FROM a""")
def roc_auc_q(spark, sf_dir):
    """Exact ROC-AUC of the arithmetic score (heavy ties, half credit)."""
    return M.roc_auc(labelled(spark, sf_dir), "label", "score")


@register("roc_auc_by_model", f"""
WITH {SCORED_MODELS_SQL}, {_AUC_SQL.format(g='model,', pg='model', src='sm')}
SELECT model, roc_auc FROM a""")
def roc_auc_by_model(spark, sf_dir):
    """E15 grouped by model."""
    return M.roc_auc(scored_models(spark, sf_dir), "label", "score", by=["model"])


@register("roc_curve", f"""
WITH {LABELLED_SQL},
s AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM lab GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS pge, sum(neg) OVER (ORDER BY score DESC) AS nge,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n,
             lag(pos) OVER (ORDER BY score) AS lpos, lag(neg) OVER (ORDER BY score) AS lneg,
             max(score) OVER () AS top FROM s)
SELECT score AS threshold, CASE WHEN n = 0 THEN 0.0 ELSE nge / n END AS fpr,
       CASE WHEN p = 0 THEN 0.0 ELSE pge / p END AS tpr FROM c
WHERE lpos IS NULL OR score = top OR lpos <> pos OR lneg <> neg
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_curve_q(spark, sf_dir):
    """ROC points (collinear intermediate points dropped, origin added)."""
    return M.roc_curve(labelled(spark, sf_dir), "label", "score")


@register("roc_curve_all_points", f"""
WITH {LABELLED_SQL},
s AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM lab GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS pge, sum(neg) OVER (ORDER BY score DESC) AS nge,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)
SELECT score AS threshold, CASE WHEN n = 0 THEN 0.0 ELSE nge / n END AS fpr,
       CASE WHEN p = 0 THEN 0.0 ELSE pge / p END AS tpr FROM c
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_curve_all_points_q(spark, sf_dir):
    """E16 without pruning: a point at every distinct score, plus the origin."""
    return M.roc_curve(labelled(spark, sf_dir), "label", "score", drop_intermediate=False)


def sweep_ctes(grid, src, g="", with_auc=True):
    """CTEs ending in ``sweep``: the brute-force per-threshold metric table."""
    gsel = f"{g}," if g else ""
    auc = (f",\n{_AUC_SQL.format(g=gsel, pg=g or '1', src=src)}" if with_auc else "")
    join = ("JOIN a USING (" + g + ")" if g else ", a") if with_auc else ""
    return f"""{_grid_sql(grid)},
cs AS (SELECT {gsel} threshold,
        CAST(count_if(label = 0 AND score < threshold) AS BIGINT) AS tn,
        CAST(count_if(label = 0 AND score >= threshold) AS BIGINT) AS fp,
        CAST(count_if(label = 1 AND score < threshold) AS BIGINT) AS fn,
        CAST(count_if(label = 1 AND score >= threshold) AS BIGINT) AS tp
      FROM grid, {src} WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY ALL){auc},
sweep AS (SELECT {gsel} threshold, tn, fp, fn, tp, {_METRICS_SQL}{", roc_auc" if with_auc else ""}
          FROM cs {join})"""


def _sweep_sql(grid, src_sql, src, g=""):
    return f"WITH {src_sql}, {sweep_ctes(grid, src, g)}\nSELECT * FROM sweep"


@register("threshold_sweep_05", _sweep_sql(arange(*M.GRID_05), LABELLED_SQL, "lab"))
def threshold_sweep_05(spark, sf_dir):
    """H1: 13-point grid 0.20..0.80 by 0.05, one pass."""
    return M.threshold_sweep(labelled(spark, sf_dir), "label", "score", arange(*M.GRID_05))


@register("threshold_sweep_01", _sweep_sql(arange(*M.GRID_01), LABELLED_SQL, "lab"))
def threshold_sweep_01(spark, sf_dir):
    """H1: 81-point grid 0.10..0.90 by 0.01, one pass."""
    return M.threshold_sweep(labelled(spark, sf_dir), "label", "score", arange(*M.GRID_01))


@register("threshold_sweep_by_model",
          _sweep_sql(arange(*M.GRID_05), SCORED_MODELS_SQL, "sm", g="model"))
def threshold_sweep_by_model(spark, sf_dir):
    """H1 grouped by model (one pass over the long scored table)."""
    return M.threshold_sweep(scored_models(spark, sf_dir), "label", "score",
                             arange(*M.GRID_05), by=["model"])


@register("fbeta", f"""
WITH {LABELLED_SQL}, {_grid_sql(arange(*M.GRID_05))},
c AS (SELECT threshold, {_CONF_SQL.format(t='threshold')} FROM grid, lab GROUP BY threshold),
m AS (SELECT threshold, {_METRICS_SQL} FROM c)
SELECT threshold, precision, recall,
       CASE WHEN 4.0 * precision + recall = 0 THEN 0.0
            ELSE 5.0 * precision * recall / (4.0 * precision + recall) END AS f2,
       CASE WHEN 0.25 * precision + recall = 0 THEN 0.0
            ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f0_5
FROM m""")
def fbeta_q(spark, sf_dir):
    """F2 and F0.5 on the 13-point sweep."""
    s = M.threshold_sweep(labelled(spark, sf_dir), "label", "score",
                          arange(*M.GRID_05), with_auc=False)
    s = M.with_fbeta(s, 2.0, out="f2")
    s = M.with_fbeta(s, 0.5, out="f0_5")
    return s.select("threshold", "precision", "recall", "f2", "f0_5")
