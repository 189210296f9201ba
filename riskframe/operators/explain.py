"""Model-agnostic explanations.

Permutation Shapley values of the positive-class probability: for each
explained row and each of P random feature orders, features are switched
from background to the row's value one at a time (forward) and back again
(backward), 2m+1 masks per order; each mask is scored against every
background row and averaged; the difference at each switch is credited to
the switched feature. Property: base + sum(shap) = f(x) exactly.

Work per explained row is P x (2m+1) x |background| scored rows. The masks
are an exploded array column and the background (a size-bounded sample)
is an exploded literal, so the only shuffle is the final aggregation, with
map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.columns import col

# Background and explained-row sample sizes, the evaluation
# budget that sets the number of permutations, and the bar floor.
BACKGROUND_SCORING = 20
BACKGROUND_REPORT = 40
EXPLAINED_REPORT = 20
MAX_EVALS = 500
BAR_FLOOR = 1e-6
TOP_N = 5


def n_permutations(m: int, max_evals: int = MAX_EVALS) -> int:
    return max(1, max_evals // (2 * m + 1))


def background_literal(background: DataFrame, features: Sequence[str],
                       max_rows: int = 1000) -> Column:
    """The background sample as an array-of-struct literal. The caller
    passes a sample (``sample_at_most``); more than ``max_rows`` rows is
    refused, so the literal's size is bounded."""
    rows = background.select(*[col(f).cast("double").alias(f"b{i}")
                               for i, f in enumerate(features)]).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"background has more than {max_rows} rows; sample it first")
    if not rows:
        raise ValueError("empty background")
    return F.array(*[F.struct(*[F.lit(float(r[i]) if r[i] is not None else None)
                                .cast("double").alias(f"b{i}")
                                for i in range(len(features))]) for r in rows])


def permutation_shap(df: DataFrame, background: DataFrame, scorer, features: Sequence[str],
                     key: str, n_perm: int | None = None, seed: int = 42, all_orders: bool = False) -> DataFrame:
    """Long table (key, feature, value, shap_value, base_value).

    ``all_orders`` takes every order of the features once (at most six features):
    the exact Shapley value of any scorer."""
    m = len(features)
    P = n_perm or n_permutations(m)
    if all_orders:
        if m > 6:
            raise ValueError("all orders are for at most six features")
        orders = list(permutations(range(m)))
        P = len(orders)
    bg = background_literal(background, features)
    x = df.select(F.col(key).alias("_key"),
                  *[col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    x = x.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(P - 1))))
    idx = F.sequence(F.lit(0), F.lit(m - 1))
    hashed = F.transform(idx, lambda j: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_key").cast("string"),
                          F.col("_p").cast("string"), j.cast("string"))).alias("h"),
        j.alias("j")))
    if all_orders:
        table = F.array(*[F.array(*[F.lit(j) for j in o]) for o in orders])
        x = x.withColumn("_perm", F.element_at(table, F.col("_p") + 1))
    else:
        x = x.withColumn("_perm", F.transform(F.array_sort(hashed), lambda s: s["j"]))
    x = x.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(2 * m))))
    # position of feature i in the permutation → is it "on" at step s?
    s = F.col("_s")
    on = []
    for i in range(m):
        pos = F.array_position(F.col("_perm"), F.lit(i)) - 1
        on.append(F.when(s <= m, pos < s).otherwise(pos >= s - m))
    z = x.select("_key", "_p", "_s", "_perm", *[o.alias(f"_on{i}") for i, o in enumerate(on)],
                 *[f"_x{i}" for i in range(m)], F.explode(bg).alias("_b"))
    z = z.select("_key", "_p", "_s", "_perm",
                 *[F.when(F.col(f"_on{i}"), F.col(f"_x{i}")).otherwise(F.col("_b")[f"b{i}"])
                   .alias(f) for i, f in enumerate(features)])
    scored = scorer(z)
    v = scored.groupBy("_key", "_p", "_s").agg(F.avg("probability").alias("_v"),
                                               F.first("_perm").alias("_perm"))
    w = Window.partitionBy("_key", "_p").orderBy("_s")  # 2m+1 rows per window
    v = v.withColumn("_prev", F.lag("_v").over(w))
    fwd = F.col("_s") <= m
    feat = F.when(fwd, F.element_at("_perm", F.col("_s"))) \
            .otherwise(F.element_at("_perm", F.col("_s") - m))
    contrib = F.when(fwd, F.col("_v") - F.col("_prev")).otherwise(F.col("_prev") - F.col("_v"))
    steps = v.where(F.col("_s") > 0).select("_key", feat.alias("_j"), contrib.alias("_c"))
    base = v.where(F.col("_s") == 0).groupBy("_key").agg(F.avg("_v").alias("base_value"))
    shap = steps.groupBy("_key", "_j").agg((F.sum("_c") / F.lit(2.0 * P)).alias("shap_value"))
    names = F.array(*[F.lit(f) for f in features])
    vals = df.select(F.col(key).alias("_key"), F.posexplode(F.array(
        *[col(f).cast("double") for f in features])).alias("_j", "value"))
    out = shap.join(vals, ["_key", "_j"]).join(base, "_key")
    return out.select(F.col("_key").alias(key), F.element_at(names, F.col("_j") + 1).alias("feature"),
                      "value", "shap_value", "base_value")


def linear_shap(df: DataFrame, background: DataFrame, weights: dict[str, float],
                key: str) -> DataFrame:
    """Closed form for an additive scorer f = sum w_j x_j + c: w_j (x_j - mean_b x_j)."""
    means = background.agg(*[F.avg(col(f)).alias(f) for f in weights]).first()
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), col(f).cast("double").alias("value"),
                              (F.lit(w) * (col(f) - F.lit(means[f]))).alias("shap_value"))
                     for f, w in weights.items()])
    return df.select(F.col(key), F.explode(rows).alias("r")).select(key, "r.*")


# E20 -----------------------------------------------------------------------
def global_importance(factors: DataFrame) -> DataFrame:
    """Mean absolute shap per feature, descending (tie → name)."""
    return (factors.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
                   .orderBy(F.col("mean_abs_shap").desc(), "feature"))


# S8 ------------------------------------------------------------------------
def top_factors(factors: DataFrame, key: str, n: int = TOP_N) -> DataFrame:
    """Top-n features of each case by |shap| (tie → feature name), with
    rounded value/shap (5 digits, half-even) and direction. The window is
    per case: m rows each."""
    w = Window.partitionBy(key).orderBy(F.abs("shap_value").desc(), "feature")
    r = factors.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return r.select(key, "rank", "feature", F.bround("value", 5).alias("value"),
                    F.bround("shap_value", 5).alias("shap_value"),
                    S.shap_direction("shap_value").alias("direction"))


# S9 ------------------------------------------------------------------------
def factor_bars(factors: DataFrame, key: str) -> DataFrame:
    """Bar width per factor: |shap| / max(max |shap| in the case, 1e-6) *
    100, capped at 100; display label of the feature name."""
    w = Window.partitionBy(key)
    mx = F.greatest(F.max(F.abs("shap_value")).over(w), F.lit(BAR_FLOOR))
    return factors.select(key, "feature", S.feature_label("feature").alias("label"),
                          F.least(F.abs("shap_value") / mx * 100, F.lit(100.0)).alias("bar_pct"))


# J16 -----------------------------------------------------------------------
def local_prediction(explained: DataFrame, scorer, labels: DataFrame, key: str,
                     label: str, threshold: float = 0.5) -> DataFrame:
    """Actual label (D1 join), predicted label at a fixed 0.5 (not the stored
    threshold) and probability of each explained row."""
    s = scorer(explained.drop(label) if label in explained.columns else explained)
    j = s.join(labels.select(key, label), key)
    return j.select(key, S.decode_label(label).alias("actual_label"),
                    S.predicted_label("probability", threshold).alias("predicted_label"),
                    F.col("probability").alias("malignant_probability"))


def explain_report(explained: DataFrame, background: DataFrame, scorer, features: Sequence[str],
                   key: str, labels: DataFrame, label: str, n_perm: int | None = None,
                   top_n: int = TOP_N, seed: int = 42) -> dict[str, DataFrame]:
    """The three explanation tables — global importance (E20), local
    top factors per case (S8) and local predictions with actual labels (D1)."""
    shap = permutation_shap(explained, background, scorer, features, key, n_perm, seed)
    return {"global_importance": global_importance(shap),
            "local_factors": top_factors(shap, key, top_n),
            "local_prediction": local_prediction(explained, scorer, labels, key, label)}
