"""Model ranking and threshold selection queries (build step 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import arange
from ..operators import metrics as M
from ..operators import select as SEL
from .catalog import register
from .inputs import LABELLED_SQL, SCORED_MODELS_SQL, labelled, scored_models, table
from .q_metrics import _AUC_SQL, _CONF_SQL, _METRICS_SQL, sweep_ctes


def _model_table(spark, sf_dir):
    """One row per model: metrics at 0.5 and ROC-AUC."""
    sm = scored_models(spark, sf_dir)
    m = M.threshold_metrics(sm, "label", "score", 0.5, by=["model"])
    return m.join(M.roc_auc(sm, "label", "score", by=["model"]), "model")


_MODEL_TABLE_SQL = f"""{SCORED_MODELS_SQL},
mc AS (SELECT model, {_CONF_SQL.format(t='0.5')} FROM sm GROUP BY model),
mm AS (SELECT model, tn, fp, fn, tp, {_METRICS_SQL} FROM mc),
{_AUC_SQL.format(g='model,', pg='model', src='sm')},
mt AS (SELECT mm.*, a.roc_auc FROM mm JOIN a USING (model))"""


@register("rank_models", f"""
WITH {_MODEL_TABLE_SQL}
SELECT model, recall, fn, roc_auc, f1,
       row_number() OVER (ORDER BY recall DESC, fn ASC, roc_auc DESC, f1 DESC, model) AS rank
FROM mt""")
def rank_models_q(spark, sf_dir):
    """G1: recall desc, false negatives asc, ROC-AUC desc, F1 desc, name."""
    r = SEL.rank_models(_model_table(spark, sf_dir), SEL.ORDER_RECALL_FN)
    return r.select("model", "recall", "fn", "roc_auc", "f1", "rank")


@register("rank_models_recall_auc", f"""
WITH {_MODEL_TABLE_SQL}
SELECT model, recall, roc_auc, f1,
       row_number() OVER (ORDER BY recall DESC, roc_auc DESC, f1 DESC, model) AS rank
FROM mt""")
def rank_models_recall_auc_q(spark, sf_dir):
    """Recall desc, ROC-AUC desc, F1 desc, name."""
    r = SEL.rank_models(_model_table(spark, sf_dir), SEL.ORDER_RECALL_AUC)
    return r.select("model", "recall", "roc_auc", "f1", "rank")


@register("best_by_auc", f"""
WITH {_MODEL_TABLE_SQL}
SELECT model, roc_auc FROM mt ORDER BY roc_auc DESC, model LIMIT 1""")
def best_by_auc_q(spark, sf_dir):
    """The model with the highest ROC-AUC (first on ties)."""
    return SEL.best_model(_model_table(spark, sf_dir), SEL.ORDER_AUC).select("model", "roc_auc")


def _recommend_sql(src_sql, src, g=""):
    part = f"PARTITION BY {g}" if g else ""
    gsel = f"{g}," if g else ""
    return f"""
WITH {src_sql}, {sweep_ctes(arange(0.20, 0.81, 0.05), src, g)},
e AS (SELECT *, CASE WHEN specificity >= 0.85 THEN 1 ELSE 0 END AS el FROM sweep),
e2 AS (SELECT *, max(el) OVER ({part}) AS anyel FROM e),
e3 AS (SELECT *, row_number() OVER ({part} ORDER BY recall DESC, fn ASC, f1 DESC,
              CASE WHEN anyel = 1 THEN specificity ELSE 0.0 END DESC, threshold ASC) AS r
       FROM e2 WHERE el = 1 OR anyel = 0)
SELECT {gsel} threshold, tn, fp, fn, tp, accuracy, precision, recall, f1, specificity,
       false_negative_rate, roc_auc, anyel = 1 AS eligible FROM e3 WHERE r = 1"""


@register("recommend_threshold", _recommend_sql(LABELLED_SQL, "lab"))
def recommend_threshold_q(spark, sf_dir):
    """G4+C2 (flagship): one-pass 13-point sweep → recall-first threshold with
    specificity >= 0.85 (fallback when none qualifies)."""
    sw = M.threshold_sweep(labelled(spark, sf_dir), "label", "score", arange(*M.GRID_05))
    return SEL.recommend_threshold(sw, SEL.MIN_SPECIFICITY)


@register("recommend_threshold_by_model", _recommend_sql(SCORED_MODELS_SQL, "sm", "model"))
def recommend_threshold_by_model_q(spark, sf_dir):
    """G4 per model (the discount-only model has no eligible threshold → fallback)."""
    sw = M.threshold_sweep(scored_models(spark, sf_dir), "label", "score",
                           arange(*M.GRID_05), by=["model"])
    return SEL.recommend_threshold(sw, SEL.MIN_SPECIFICITY, by=["model"])


_F2_SQL = f"""
{sweep_ctes(arange(0.10, 0.91, 0.01), 'sm', 'model', with_auc=False)},
fb AS (SELECT *, CASE WHEN 4.0 * precision + recall = 0 THEN 0.0
                 ELSE 5.0 * precision * recall / (4.0 * precision + recall) END AS fbeta FROM sweep),
best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY fbeta DESC, recall DESC,
                precision DESC, threshold ASC) AS r FROM fb),
sel AS (SELECT model,
  CASE WHEN fbeta = 0 AND recall = 0 AND precision = 0 THEN 0.5
       ELSE round(threshold * 100) / 100 END AS selected_threshold,
  CASE WHEN fbeta = 0 AND recall = 0 AND precision = 0 THEN 0.0 ELSE fbeta END AS fbeta,
  CASE WHEN fbeta = 0 AND recall = 0 AND precision = 0 THEN 0.0 ELSE recall END AS recall,
  CASE WHEN fbeta = 0 AND recall = 0 AND precision = 0 THEN 0.0 ELSE precision END AS precision,
  CASE WHEN fbeta = 0 AND recall = 0 AND precision = 0 THEN 0.0 ELSE f1 END AS f1
  FROM best WHERE r = 1)"""


@register("select_threshold_f2", f"""
WITH {SCORED_MODELS_SQL}, {_F2_SQL}
SELECT * FROM sel""")
def select_threshold_f2_q(spark, sf_dir):
    """Per model, the 81-point grid threshold maximising (F2, recall, precision)."""
    return SEL.select_threshold_fbeta(scored_models(spark, sf_dir), "label", "score",
                                      arange(*M.GRID_01), 2.0, by=["model"])


@register("choose_candidate", f"""
WITH {SCORED_MODELS_SQL}, {_F2_SQL},
cand AS (SELECT *, 0 AS pref FROM sel WHERE model = 'arith'
         UNION ALL SELECT *, 1 AS pref FROM sel WHERE model = 'quantity')
SELECT model, selected_threshold, fbeta, recall, precision, f1 FROM cand
ORDER BY fbeta DESC, recall DESC, pref ASC LIMIT 1""")
def choose_candidate_q(spark, sf_dir):
    """Base ('arith') vs challenger ('quantity') on F2 then recall; the
    base is kept on a tie."""
    sel = SEL.select_threshold_fbeta(scored_models(spark, sf_dir), "label", "score",
                                     arange(*M.GRID_01), 2.0, by=["model"])
    return SEL.choose_candidate(sel.where(F.col("model") == "arith"),
                                sel.where(F.col("model") == "quantity"))


@register("top_k", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def top_k_q(spark, sf_dir):
    """Ten most expensive parts (tie → key)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return SEL.top_k(p, "p_retailprice", 10, tie="p_partkey")


@register("first_row", f"""
WITH {LABELLED_SQL} SELECT case_key, label, score FROM lab ORDER BY case_key LIMIT 1""")
def first_row_q(spark, sf_dir):
    """First case by an explicit order."""
    return SEL.first_row(labelled(spark, sf_dir).select("case_key", "label", "score"), ["case_key"])
