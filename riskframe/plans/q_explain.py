"""Explanation queries (build step 8). The scorer is additive
(f = (2 q + 1000 d + 500 t) / 260), so the exact Shapley value is the closed
form w_j (x_j - mean background x_j) and the DuckDB twin computes that; the
Spark side runs the full permutation algorithm. Explained rows and
background are the reference's samples: 20 test rows and 40 training rows
(md5 order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import explain as X
from ..operators import factors as FA
from ..operators import sampling as SM
from ..operators import scoring as SC
from .catalog import register
from .inputs import FEATURES, LABELLED_SQL, labelled
from .q_sampling import _holdout_sql

WEIGHTS = {"l_quantity": 2 / 260.0, "l_extendedprice": 0.0, "l_discount": 1000 / 260.0,
           "l_tax": 500 / 260.0}


def _expr():
    return F.expr("(l_quantity * 2 + l_discount * 1000 + l_tax * 500) / 260.0")


def _parts(spark, sf_dir):
    from pyspark import StorageLevel
    lab = labelled(spark, sf_dir)
    # the split feeds the explained sample, the background sample and the
    # background literal: materialise it once (memory, spilling to disk)
    s = SM.stratified_holdout(lab, "label", 0.2, "case_key", 42).persist(StorageLevel.MEMORY_AND_DISK)
    explained = SM.sample_n(s.where(F.col("split") == "test"), X.EXPLAINED_REPORT, "case_key", 7)
    background = SM.sample_n(s.where(F.col("split") == "train"), X.BACKGROUND_REPORT, "case_key", 42)
    return explained, background


def _scored_cases(spark, sf_dir):
    """All test rows and the background of 40 training rows."""
    from pyspark import StorageLevel
    lab = labelled(spark, sf_dir)
    s = SM.stratified_holdout(lab, "label", 0.2, "case_key", 42).persist(StorageLevel.MEMORY_AND_DISK)
    return s.where(F.col("split") == "test"), SM.sample_n(s.where(F.col("split") == "train"), X.BACKGROUND_REPORT, "case_key", 42)


def _case_factors(spark, sf_dir):
    cases, background = _scored_cases(spark, sf_dir)
    return FA.linear_factors(cases, background, WEIGHTS)


def _shap(spark, sf_dir):
    explained, background = _parts(spark, sf_dir)
    return X.permutation_shap(explained, background, SC.expression_scorer(_expr()), FEATURES,
                              "case_key")


def _base_sql(cases: str) -> str:
    return f"""
WITH {LABELLED_SQL}, {_holdout_sql('lab', 0.2, '42', 'j')},
ex AS (SELECT * FROM j WHERE split = 'test' {cases}),
bg AS (SELECT * FROM j WHERE split = 'train' ORDER BY md5(concat_ws('|', '42', case_key)), case_key LIMIT 40),
bm AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in FEATURES)} FROM bg),
sh AS ({' UNION ALL '.join(f"SELECT case_key, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {WEIGHTS[c]!r} * ({c} - m_{c}) AS shap_value FROM ex, bm" for c in FEATURES)})"""


#: The reports explain 20 cases; factors of scored cases are of every case.
_BASE_SQL = _base_sql("ORDER BY md5(concat_ws('|', '7', case_key)), case_key LIMIT 20")
_ALL_SQL = _base_sql("")


@register("permutation_shap", _BASE_SQL + "\nSELECT case_key, feature, value, shap_value FROM sh")
def permutation_shap_q(spark, sf_dir):
    """Permutation Shapley values (55 orders, 40 background rows) of
    20 explained test rows."""
    return _shap(spark, sf_dir).select("case_key", "feature", "value", "shap_value")


@register("global_importance", _BASE_SQL + """
SELECT feature, avg(abs(shap_value)) AS mean_abs_shap FROM sh GROUP BY feature""")
def global_importance_q(spark, sf_dir):
    """Mean |shap| per feature over the explained rows."""
    return X.global_importance(_shap(spark, sf_dir))


@register("top_factors", _ALL_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY abs(shap_value) DESC, feature) AS rank FROM sh)
SELECT case_key, rank, feature, round_even(value, 5) AS value, round_even(shap_value, 5) AS shap_value,
       CASE WHEN shap_value > 0 THEN 'increases malignant risk' ELSE 'reduces malignant risk' END AS direction
FROM r WHERE rank <= 5""")
def top_factors_q(spark, sf_dir):
    """Top-5 factors of every test case with direction."""
    return FA.long_top(_case_factors(spark, sf_dir), "case_key", n=5)


@register("factor_bars", _ALL_SQL + """
SELECT case_key, feature,
  array_to_string(list_transform(string_split(feature, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label,
  least(abs(shap_value) / greatest(max(abs(shap_value)) OVER (PARTITION BY case_key), 1e-6) * 100, 100.0) AS bar_pct
FROM sh""")
def factor_bars_q(spark, sf_dir):
    """Normalised bar widths of the factors of every test case."""
    return FA.long_bars(_case_factors(spark, sf_dir), "case_key")


@register("local_prediction", f"""
WITH {LABELLED_SQL}, {_holdout_sql('lab', 0.2, '42', 'j')},
ex AS (SELECT * FROM j WHERE split = 'test' ORDER BY md5(concat_ws('|', '7', case_key)), case_key LIMIT 20)
SELECT case_key, CASE WHEN label = 1 THEN 'Malignant' WHEN label = 0 THEN 'Benign' END AS actual_label,
  CASE WHEN (l_quantity * 2 + l_discount * 1000 + l_tax * 500) / 260.0 >= 0.5 THEN 'Malignant' ELSE 'Benign' END AS predicted_label,
  (l_quantity * 2 + l_discount * 1000 + l_tax * 500) / 260.0 AS malignant_probability FROM ex""")
def local_prediction_q(spark, sf_dir):
    """Actual label (joined by key), label at 0.5 and probability of
    the explained rows."""
    explained, _ = _parts(spark, sf_dir)
    labels = labelled(spark, sf_dir).select("case_key", "label")
    return X.local_prediction(explained.drop("label"), SC.expression_scorer(_expr()), labels,
                              "case_key", "label", 0.5)


def _forest(spark, sf_dir):
    """A fitted forest with the test rows that it scores and its background."""
    from ..operators import models as ML
    from .q_models import _split
    s = _split(spark, sf_dir)
    train = s.where(F.col("split") == "train")
    forest = ML.fit_forest(train, FEATURES, "label")
    # a seed of its own: in the split's order the first training rows are all of one class
    return forest, s.where(F.col("split") == "test"), SM.sample_n(train, X.BACKGROUND_REPORT, "case_key", 7)


@register("forest_factors", f"""
WITH {LABELLED_SQL},
planted AS (SELECT * REPLACE (CAST(l_discount * 10 + l_tax * 10 > 0.9 AS INTEGER) AS label) FROM lab),
{_holdout_sql('planted', 0.2, '42', 'j')}
SELECT case_key, TRUE AS adds_up, CAST(4 AS BIGINT) AS n_factors,
       CASE WHEN hundredths >= 12 THEN 'increases malignant risk' WHEN hundredths <= 6 THEN 'reduces malignant risk' END AS clear_direction
FROM (SELECT *, round(l_discount * 100) + round(l_tax * 100) AS hundredths FROM j WHERE split = 'test')""")
def forest_factors_q(spark, sf_dir):
    """J12+J15 with a fitted 300-tree forest: closed-form factors of every test case.
    Base value and factors must add up to the probability that the model itself gives;
    their sum's direction is known where the case is clear of the planted boundary."""
    from ..operators import models as ML
    forest, cases, background = _forest(spark, sf_dir)
    base = ML.positive_score(forest, background, "p").agg(F.avg("p")).first()[0]
    f = FA.tree_factors(ML.positive_score(forest, cases, "probability").select("case_key", "probability", *FEATURES), background, forest)
    total = F.aggregate("factors", F.lit(0.0), lambda acc, s: acc + s["shap_value"])
    steps = F.round(F.col("l_discount") * 100) + F.round(F.col("l_tax") * 100)
    return f.select("case_key", (F.abs(total + F.lit(base) - F.col("probability")) < 1e-9).alias("adds_up"), F.size("factors").cast("long").alias("n_factors"),
                    F.when((steps >= 12) | (steps <= 6), S.shap_direction(total)).alias("clear_direction"))


@register("response_with_factors")
def response_with_factors_q(spark, sf_dir):
    """D3+I19: every test case scored with a fitted forest, its top-5 factors in the
    same pass, and the nested JSON response."""
    from ..operators import models as ML
    forest, cases, background = _forest(spark, sf_dir)
    scorer = SC.model_scorer(forest, FEATURES)
    pred = SC.score_cases(FA.tree_factors(cases.select("case_key", *FEATURES), background, forest), scorer, 0.5, "case_key", keep=["factors"])
    return SC.response_json(pred.withColumn("top_factors", FA.top_of(F.col("factors"), 5)))
