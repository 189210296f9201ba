"""Scoring: probability → label, risk band, case
id and response, as one projection after the scorer; no Python UDF.

A *scorer* is any ``DataFrame -> DataFrame`` that adds a ``probability``
column (the positive-class probability). ``model_scorer`` wraps a fitted
Spark ML model; ``expression_scorer`` wraps a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

Scorer = Callable[[DataFrame], DataFrame]


def expression_scorer(expr: Column, out: str = "probability") -> Scorer:
    def run(df: DataFrame) -> DataFrame:
        return df.withColumn(out, expr.cast("double"))
    return run


def model_scorer(model, features: Sequence[str], out: str = "probability",
                 vector_col: str = "features") -> Scorer:
    """Spark ML model (a PipelineModel that takes the feature columns, or a
    bare model that takes an assembled vector) → positive-class probability.
    A model without probabilities is refused: calibrate it first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def run(df: DataFrame) -> DataFrame:
        d = df
        if vector_col not in df.columns and not _is_pipeline(model):
            d = VectorAssembler(inputCols=list(features), outputCol=vector_col,
                                handleInvalid="keep").transform(df)
        res = model.transform(d)
        if "probability" not in res.columns:
            raise ValueError("the model gives margins, not probabilities; calibrate it first")
        prob = vector_to_array(F.col("probability"))[1]
        keep = [c for c in df.columns if c != out]
        return res.select(*keep, prob.alias(out))
    return run


def _is_pipeline(model) -> bool:
    from pyspark.ml import PipelineModel
    return isinstance(model, PipelineModel)


# J15 -----------------------------------------------------------------------
def score_cases(df: DataFrame, scorer: Scorer, threshold: float, key: str,
                keep: Sequence[str] = ()) -> DataFrame:
    """case_key, case_id, probability (fraction), probability_pct (percent, 2
    digits), prediction, risk_level, threshold; one pass, no shuffle."""
    if not 0.0 <= float(threshold) <= 1.0:  # C6
        raise ValueError("Prediction threshold must be between 0 and 1.")
    scored = scorer(df)
    p = F.col("probability")
    return scored.select(
        *keep, F.col(key).alias("case_key"), S.case_id(F.col(key)).alias("case_id"),
        p.alias("probability"), S.percent2(p).alias("probability_pct"),
        S.predicted_label(p, threshold).alias("prediction"),
        S.risk_level(p, threshold).alias("risk_level"),
        F.lit(float(threshold)).alias("threshold"))


# D1 ------------------------------------------------------------------------
def join_labels(df: DataFrame, labels: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Attach actual labels by key (an equi-join; Catalyst picks the strategy,
    AQE turns it into a broadcast when the labels side proves small)."""
    return df.join(labels, key, how)


# D3 ------------------------------------------------------------------------
def attach_factors(pred: DataFrame, factors: DataFrame, key: str = "case_id",
                   n: int = 5) -> DataFrame:
    """Prediction + its top-n factors as an ordered array<struct>. ``factors``
    must carry ``rank`` (1 = strongest); only rank <= n is gathered, so each
    collected list is bounded by n."""
    top = factors.where(F.col("rank") <= n)
    arr = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "rank", "feature", "value", "shap_value", "direction"))).alias("_f"))
    arr = arr.select(key, F.transform("_f", lambda s: s.dropFields("rank")).alias("top_factors"))
    return pred.join(arr, key, "left")


# I19 -----------------------------------------------------------------------
def response_struct(df: DataFrame, file_col: Column | None = None) -> Column:
    """Nested response: percent probability, threshold, band, factors,
    record location and disclaimer."""
    factors = F.col("top_factors") if "top_factors" in df.columns else \
        F.array().cast("array<struct<feature:string,value:double,shap_value:double,direction:string>>")
    return F.struct(
        F.col("case_id").alias("case_id"), F.col("prediction").alias("prediction"),
        F.col("probability_pct").alias("malignant_probability"),
        F.col("threshold").alias("decision_threshold"), F.col("risk_level").alias("risk_level"),
        factors.alias("top_factors"),
        (file_col if file_col is not None else
         F.concat(F.col("case_id"), F.lit("_prediction.csv"))).alias("prediction_file"),
        F.lit(S.DISCLAIMER).alias("disclaimer"))


def response_json(df: DataFrame) -> DataFrame:
    return df.select("case_id", F.to_json(response_struct(df)).alias("response"))
