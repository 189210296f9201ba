"""Model operators on Spark ML.

Every fitted model is a ``PipelineModel`` (persistable with ``save`` /
``load``): a ``SQLTransformer`` that standardises with population std, a
``VectorAssembler`` and the estimator. Fitting is Spark ML's distributed
``treeAggregate`` optimisation; only model parameters (a few numbers per
feature) ever reach the driver.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.columns import q
from . import forest
from . import metrics as M
from .ranking import sized_broadcast
from .svm import fit_fourier_svms

Z = "__z_"  # prefix of standardised columns
# The functions that run inside tasks travel with them: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
PARALLEL_ROWS = 2_000_000  # up to here folds are fitted side by side; each keeps its rows meanwhile
SAMPLED_NUMBERS = 4_000_000  # of training vectors, which place the cuts between cells


# J1 ------------------------------------------------------------------------
def standard_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (one aggregate; 2 numbers per
    column reach the driver). A constant column gets std 1."""
    row = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (float(m or 0.0), float(s) if s and s > 0 else 1.0)
    return out


def standardiser(stats: dict[str, tuple[float, float]], prefix: str = Z) -> SQLTransformer:
    """Persistable projection (x - mean) / std for each column."""
    exprs = ", ".join(f"({q(c)} - {m!r}) / {s!r} AS {q(prefix + c)}" for c, (m, s) in stats.items())
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def standardise(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardise ``df`` with statistics fitted on ``train`` only."""
    stats = standard_stats(train, cols)
    return df.select("*", *[((F.col(q(c)) - m) / s).alias(c + "_z")
                            for c, (m, s) in stats.items()])


# Estimators ----------------------------------------------------------------
def _weight_sum(df: DataFrame, weight: str | None) -> float:
    if weight is None:
        return float(df.count())
    return float(df.agg(F.sum(weight)).first()[0])


def _pipeline(stats, cols, estimator) -> Pipeline:
    return Pipeline(stages=[standardiser(stats),
                            VectorAssembler(inputCols=[Z + c for c in cols], outputCol="features"),
                            estimator])


def fit_logistic(df: DataFrame, cols: Sequence[str], label: str = "label", C: float = 1.0,
                 balanced: bool = True, max_iter: int = 3000, tol: float = 1e-9,
                 regParam: float | None = None) -> PipelineModel:
    """L2 logistic regression on standardised features with the objective
    C * sum(w_i * loss_i) + |beta|^2 / 2, i.e. Spark's regParam = 1 / (C * sum w)
    (the intercept is not penalised). ``regParam``, where given, takes the place of C."""
    d = M.with_class_weight(df, label, "_w") if balanced else df.withColumn("_w", F.lit(1.0))
    stats = standard_stats(d, cols)
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w",
                            regParam=1.0 / (C * _weight_sum(d, "_w")) if regParam is None else regParam,
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    return _pipeline(stats, cols, lr).fit(d)


def fit_tree(df: DataFrame, cols: Sequence[str], label: str = "label", max_depth: int = 5,
             balanced: bool = True, seed: int = 42, max_bins: int = 64) -> PipelineModel:
    d = M.with_class_weight(df, label, "_w") if balanced else df.withColumn("_w", F.lit(1.0))
    stats = standard_stats(d, cols)
    est = DecisionTreeClassifier(featuresCol="features", labelCol=label, weightCol="_w",
                                 maxDepth=max_depth, seed=seed, maxBins=max_bins)
    return _pipeline(stats, cols, est).fit(d)


def fit_forest(df: DataFrame, cols: Sequence[str], label: str = "label", n_trees: int = 300,
               max_depth: int | None = None, balanced: bool = True, min_split: int = 2,
               seed: int = 42, max_bins: int = 64) -> PipelineModel:
    """Random forest; unlimited depth maps to Spark's cap of 30; a minimum
    split size of s maps to at least ceil(s/2) rows per leaf.

    From ``forest.CELL_ROWS`` rows on it is grown on the counted cells of the binned
    features (``forest``): the same method with random numbers of its own."""
    n = {r[0]: r[1] for r in df.groupBy(F.col(label)).count().collect()}
    d = M.with_class_weight(df, label, "_w") if balanced else df.withColumn("_w", F.lit(1.0))
    est = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w",
                                 numTrees=n_trees, maxDepth=min(max_depth or 30, 30),
                                 minInstancesPerNode=max(1, math.ceil(min_split / 2)),
                                 seed=seed, maxBins=max_bins)
    if sum(n.values()) >= forest.CELL_ROWS and set(n) == {0, 1}:
        gap = reduce(lambda a, c: a | c.isNull() | F.isnan(c), [F.col(q(c)).cast("double") for c in cols], F.lit(False))
        if not df.where(gap).isEmpty():
            raise ValueError("a feature is missing: the rows of a fit need every feature")
        stats = standard_stats(df, cols)
        weights = tuple(sum(n.values()) / (2 * n[c]) if balanced else 1.0 for c in (0, 1))
        fitted = forest.fit_cells(df, cols, label, stats, weights, sum(n.values()), est)
        if fitted is not None:
            return PipelineModel(stages=[*_pipeline(stats, cols, est).getStages()[:2], fitted])
    return _pipeline(standard_stats(d, cols), cols, est).fit(d)


# J3 ------------------------------------------------------------------------
def rff_transformer(cols: Sequence[str], n_components: int, gamma: float,
                    seed: int = 42, prefix: str = "__rff_") -> SQLTransformer:
    """Random Fourier features for the RBF kernel exp(-gamma |x - y|^2)
    (Rahimi & Recht 2007): z_d(x) = sqrt(2/D) cos(w_d . x + b_d) with
    w ~ N(0, 2 gamma I), b ~ U(0, 2 pi). The D x m weights are model
    parameters written into the projection (a persistable SQL statement)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, len(cols)))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    parts = []
    for d in range(n_components):
        dot = " + ".join(f"{float(w[d, j])!r} * {q(Z + c)}" for j, c in enumerate(cols))
        parts.append(f"{scale!r} * cos({dot} + {float(b[d])!r}) AS {q(prefix + str(d))}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fourier_components(model: PipelineModel):
    """(standardised input columns, rows of weights with the phase last, scale) of a
    pipeline with random Fourier features, read from its projection; else None."""
    if len(model.stages) < 4 or not isinstance(model.stages[1], SQLTransformer):
        return None
    return _fourier_parts(model.stages[1])


def _fourier_parts(projection: SQLTransformer):
    rows, names, scale = [], [], None
    for factor, inner in re.findall(r"(\S+) \* cos\((.*?)\) AS `__rff_", projection.getStatement()):
        *terms, phase = inner.split(" + ")
        pairs = [t.split(" * ", 1) for t in terms]
        names, scale = [n for _, n in pairs], float(factor)
        rows.append([*(float(w) for w, _ in pairs), float(phase)])
    return (names, rows, scale) if rows else None


def fourier_function(components: Sequence[Sequence[float]], scale: float):
    """Batches of standardised columns -> matrix of random Fourier features; ``components``
    are rows of weights with the phase last. Sums run as in the projection's SQL."""
    w = np.array(components, float)

    def project(columns) -> np.ndarray:
        dot = np.zeros((len(columns[0]), len(w)))
        for j, x in enumerate(columns):
            dot += np.asarray(x, float)[:, None] * w[:, j]
        return scale * np.cos(dot + w[:, -1])
    return project


def fit_svm(df: DataFrame, cols: Sequence[str], label: str = "label", C: float = 1.0,
            kernel: str = "rbf", gamma: float | str = "scale", n_components: int = 200,
            balanced: bool = True, max_iter: int = 200, seed: int = 42) -> PipelineModel:
    """SVM with hinge loss and the objective C * sum(w_i * hinge_i) + |beta|^2/2.
    kernel='linear' → LinearSVC on standardised features; kernel='rbf' →
    LinearSVC on random Fourier features: an APPROXIMATION of the kernel
    machine, not an exact solver. gamma 'scale' = 1 / (m * var(X)) on the
    standardised features, 'auto' = 1 / m."""
    if kernel != "linear":
        return fit_fourier_svms(df, cols, label, None, [None], C, gamma, n_components, balanced, max_iter, seed)[0]
    d = M.with_class_weight(df, label, "_w") if balanced else df.withColumn("_w", F.lit(1.0))
    svc = LinearSVC(featuresCol="features", labelCol=label, weightCol="_w",
                    regParam=1.0 / (C * _weight_sum(d, "_w")), standardization=False,
                    maxIter=max_iter)
    return _pipeline(standard_stats(d, cols), cols, svc).fit(d)


class FourierSvm:
    """``fit_svm`` of the RBF kernel with its settings, as a fit: called on rows it gives one
    model, ``of_folds`` those of every fold (fitted on the other folds' rows) from one pass
    a step over all rows."""

    def __init__(self, cols: Sequence[str], label: str = "label", C: float = 1.0, gamma: float | str = "scale",
                 n_components: int = 200, balanced: bool = True, max_iter: int = 200, seed: int = 42):
        self.cols, self.label = list(cols), label
        self.settings = (C, gamma, n_components, balanced, max_iter, seed)

    def __call__(self, df: DataFrame) -> PipelineModel:
        return fit_fourier_svms(df, self.cols, self.label, None, [None], *self.settings)[0]

    def of_folds(self, df: DataFrame, fold_col: str, folds: int) -> list[PipelineModel]:
        return fit_fourier_svms(df, self.cols, self.label, fold_col, range(folds), *self.settings)


# Scores --------------------------------------------------------------------
def positive_score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Class-1 probability when the model has one, else the decision value."""
    if fourier_components(model) is not None:
        from .published import with_decision
        res = with_decision(model, df, out)
        s = F.col(q(out))
    elif "probability" in (res := model.transform(df)).columns:
        s = vector_to_array("probability")[1]
    else:
        s = vector_to_array("rawPrediction")[1]
    drop = {"features", "rawPrediction", "probability", "prediction", out}
    own = [c for c in res.columns if c not in drop and not c.startswith((Z, "__rff_"))]
    return res.select(*[F.col(q(c)) for c in own], s.alias(out))


def decision_cut(model) -> float:
    """Where a model's ``positive_score`` turns positive: 0.5 for a probability, 0 for
    the margin of a model without probabilities."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    return 0.5 if hasattr(stage, "getProbabilityCol") or not isinstance(model, PipelineModel) else 0.0


def decided(model, df: DataFrame, score: str = "score", out: str = "prediction") -> DataFrame:
    """``df`` with the model's class-1 score and its 0/1 decision at the model's own cut;
    no decision where the score is missing. A model is a pipeline or any object whose
    call adds ``score`` as a class-1 probability (``NeighbourModel``)."""
    d = positive_score(model, df, score) if isinstance(model, PipelineModel) else model(df, score)
    return d.withColumn(out, F.when(M.has_score(score), (F.col(score) >= decision_cut(model)).cast("int")))


def coefficients(model: PipelineModel, cols: Sequence[str]) -> list[tuple[str, float]]:
    lr = model.stages[-1]
    return [("intercept", float(lr.intercept))] + \
        [(c, float(v)) for c, v in zip(cols, lr.coefficients.toArray())]


# J7 ------------------------------------------------------------------------
def feature_importance(spark, model: PipelineModel, cols: Sequence[str]) -> DataFrame:
    """Impurity importance of a tree model, sorted desc (one row per feature)."""
    imp = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(cols, (float(x) for x in imp)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


# J10 -----------------------------------------------------------------------
def platt(scores: DataFrame, label: str = "label", score: str = "raw", max_iter: int = 50,
          tol: float = 1e-10) -> tuple[float, float]:
    """Platt scaling with the smoothed targets (n+ + 1)/(n+ + 2) and 1/(n- + 2):
    (a, b) of p = 1 / (1 + exp(-(a * s + b))) by Newton's method with step halving.

    A step is one aggregate over the scores (loss, gradient and curvature: six
    numbers reach the driver), and about eight steps suffice at any size. Rows
    without a score are left out; without any row (a, b) is (0, 0)."""
    return platt_folds(scores.withColumn("fold", F.lit(0)), 1, label, score, max_iter, tol)[0]


def _platt_steps(p: int, n: int, max_iter: int, tol: float):
    """Newton's steps of one fold as a generator: yields (a, b), is sent the six sums there."""
    a, b = 0.0, math.log((p + 1.0) / (n + 1.0))
    now = yield a, b
    for _ in range(max_iter):
        loss, ga, gb, haa, hab, hbb = now
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        if max(abs(ga), abs(gb)) <= tol * max(1.0, loss) or det <= 0:
            break
        da, db = (hab * gb - hbb * ga) / det, (hab * ga - haa * gb) / det
        step = 1.0
        while step > 1e-10:
            then = yield a + step * da, b + step * db
            if then[0] <= loss + 1e-4 * step * (ga * da + gb * db) or (step == 1.0 and abs(then[0] - loss) <= 1e-12 * abs(loss)):
                break
            step /= 2
        a, b, gained, now = a + step * da, b + step * db, loss - then[0], then
        if gained <= 1e-13 * max(1.0, loss):
            break
    return a, b


def platt_folds(scores: DataFrame, folds: int, label: str = "label", score: str = "raw", max_iter: int = 50,
                tol: float = 1e-10) -> list[tuple[float, float]]:
    """``platt`` of every fold (column ``fold``, 0 to ``folds`` - 1), a step being one
    aggregate over the scores of all folds that are not done."""
    d = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col("fold").between(0, folds - 1))
    d = d.select("fold", F.col(score).cast("double").alias("s"), (F.col(label) == 1).alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["fold"]: (r["p"], r["n"]) for r in d.groupBy("fold").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n")).collect()}
        out = [(0.0, 0.0)] * folds
        steps = {k: _platt_steps(p, n, max_iter, tol) for k, (p, n) in sizes.items() if p + n}
        asked = {k: next(s) for k, s in steps.items()}

        def of(values: dict) -> Column:
            return reduce(lambda e, i: e.when(F.col("fold") == i[0], F.lit(float(i[1]))), values.items(), F)

        while asked:
            z = F.col("s") * of({k: at[0] for k, at in asked.items()}) + of({k: at[1] for k, at in asked.items()})
            t = F.when(F.col("y"), of({k: (sizes[k][0] + 1.0) / (sizes[k][0] + 2.0) for k in asked})).otherwise(of({k: 1.0 / (sizes[k][1] + 2.0) for k in asked}))
            e = d.where(F.col("fold").isin(*asked)).select("fold", "s", z.alias("z"), t.alias("t")).select("*", (1.0 / (1.0 + F.exp(-F.col("z")))).alias("p"))
            z, p, t = F.col("z"), F.col("p"), F.col("t")
            w, r = p * (1.0 - p), p - t
            loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - t * z
            sums = e.groupBy("fold").agg(F.sum(loss), F.sum(r * F.col("s")), F.sum(r), F.sum(w * F.col("s") * F.col("s")), F.sum(w * F.col("s")), F.sum(w)).collect()
            for row in sums:
                k = row["fold"]
                try:
                    asked[k] = steps[k].send(tuple(row)[1:])
                except StopIteration as end:
                    out[k] = end.value
                    del asked[k]
        return out
    finally:
        d.unpersist()


def calibrate_sigmoid(df: DataFrame, fit_fn, label: str = "label", folds: int = 5,
                      fold_col: str = "fold", parallelism: int = 4,
                      features: Sequence[str] | None = None, threshold: float = 0.5):
    """Per fold k: fit on the other folds, Platt-scale the fold's decision
    values; the calibrated probability is the mean over the k (model, a, b).
    Returns a ``CalibratedModel``, which is a scorer and can be written.

    ``features`` are the columns that fit_fn's pipelines read; by default those
    that their standardiser names. The training rows are checkpointed once (shared
    folder) so the 2k iterative fits do not re-run the split/fold lineage."""
    from ..session import written
    from .published import CalibratedModel, with_decision
    if hasattr(fit_fn, "of_folds"):
        df = written(df.select(*dict.fromkeys([*fit_fn.cols, label, fold_col])), "folds")
        models = fit_fn.of_folds(df, fold_col, folds)
        held = reduce(DataFrame.unionByName, (with_decision(m, df.where(F.col(fold_col) == k), "raw").select(F.lit(k).alias("fold"), label, "raw")
                                              for k, m in enumerate(models)))
        return CalibratedModel(models, platt_folds(held, folds, label, "raw"), list(features or fit_fn.cols), threshold)
    df = written(df, "folds")
    if df.count() > PARALLEL_ROWS:  # one fold alone keeps all cores busy
        parallelism = 1

    def one(k):
        model = fit_fn(df.where(F.col(fold_col) != k))
        held = with_decision(model, df.where(F.col(fold_col) == k), "raw").select(label, "raw")
        return model, *platt(held, label, "raw")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(one, range(folds)))
    names = list(features) if features else standardised_columns(parts[0][0])
    return CalibratedModel([p[0] for p in parts], [p[1:] for p in parts], names, threshold)


def standardised_columns(model: PipelineModel) -> list[str]:
    """The input columns that a pipeline's standardiser reads, in order."""
    found = re.findall(r"AS `" + re.escape(Z) + r"((?:[^`]|``)+)`", model.stages[0].getStatement())
    return [c.replace("``", "`") for c in found]


def standardised_moments(model: PipelineModel) -> dict[str, tuple[float, float]]:
    """(mean, deviation) of each column that a pipeline's standardiser reads."""
    found = re.findall(r"\(`((?:[^`]|``)+)` - (\S+)\) / (\S+) AS ", model.stages[0].getStatement())
    return {c.replace("``", "`"): (float(m), float(s)) for c, m, s in found}


# J8 ------------------------------------------------------------------------
def _held_out(df: DataFrame, fit_fn, label: str, fold_col: str, key: str | None, folds: int,
              parallelism: int) -> tuple[list, DataFrame]:
    """The fold models, and every row scored and decided by the model of the folds it is not in:
    (fold, key, label, score, prediction). ``fit_fn`` sees the other folds alone, so its
    scaler, class weights and penalty are those of a fold's own training rows."""
    joint = fit_fn.of_folds(df, fold_col, folds) if hasattr(fit_fn, "of_folds") else None

    def one(k):
        model = joint[k] if joint else fit_fn(df.where(F.col(fold_col) != k))
        s = decided(model, df.where(F.col(fold_col) == k))
        return model, s.select(F.lit(k).alias(fold_col), *([key] if key else []), label, "score", "prediction")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(one, range(folds)))
    out = parts[0][1]
    for _, p in parts[1:]:
        out = out.unionByName(p)
    return [m for m, _ in parts], out


def cross_validate(df: DataFrame, fitters: dict, label: str = "label",
                   fold_col: str = "fold", key: str = "case_key",
                   threshold: float | None = None, parallelism: int = 4, folds: int = 5) -> DataFrame:
    """Fit every (model, fold) from a driver thread pool, score the held-out
    fold, and compute metrics + ROC-AUC grouped by (model, fold) over the
    long scored table. Returns one row per (model, fold). A row is positive at its
    model's own cut (0.5, or 0 for margins) or from ``threshold`` on where one is given.
    A fold without rows has no row."""
    counts = None
    for name, fit_fn in fitters.items():
        models, s = _held_out(df, fit_fn, label, fold_col, key, folds, parallelism)
        if threshold is not None:
            s = s.withColumn("prediction", F.when(M.has_score("score"), (F.col("score") >= F.lit(threshold)).cast("int")))
        c = M.score_outcomes(s.withColumn("model", F.lit(name)), label, "score", "prediction", ["model", fold_col])
        c.count()  # every held-out row is scored once, then the models' frames go
        release(models)
        counts = c if counts is None else counts.unionByName(c)
    return M.outcome_metrics(counts, "score", "prediction", ["model", fold_col])


# J11 -----------------------------------------------------------------------
def evaluate_models(train: DataFrame, test: DataFrame, fitters: dict, label: str = "label",
                    key: str = "case_key") -> DataFrame:
    """One row per model: fitted on ``train``, decided on ``test`` at its own cut,
    confusion counts, metrics and exact ROC-AUC from one table of score counts."""
    def one(item):
        name, fit_fn = item
        model = fit_fn(train)
        s = decided(model, test).select(F.lit(name).alias("model"), key, label, "score", "prediction")
        c = M.score_outcomes(s, label, "score", "prediction", ["model"])
        c.count()  # every test row is scored once, then the model's frames go
        release([model])
        return c

    counts = reduce(DataFrame.unionByName, map(one, fitters.items()))
    return M.outcome_metrics(counts, "score", "prediction", ["model"])


# J9 ------------------------------------------------------------------------
#: Families that ``grid_search`` knows and their fits.
FAMILIES = {"logistic": fit_logistic, "forest": fit_forest, "tree": fit_tree, "svm": fit_svm}


def grid_search(df: DataFrame, cols: Sequence[str], label: str, estimator: str,
                grid: Sequence[dict], fold_col: str = "fold", parallelism: int = 4,
                folds: int = 5, balanced: bool = False):
    """Mean exact ROC-AUC of every setting over the folds, then a refit of the best one
    on all rows: (best PipelineModel, table of setting, params, roc_auc). Ties go to the
    first setting. A setting holds arguments of the family's fit; ``regParam`` of the
    logistic family stands for the penalty itself, in place of C.

    Scaler, class weights and penalty are fitted inside each fold; the logistic fits of all
    settings and folds are taken together (``_grid_scores``). A setting's fold models are dropped before the next setting, so the driver never holds more than
    ``folds`` models; a fold whose held-out rows have one class is left out of the mean."""
    if estimator not in FAMILIES:
        raise ValueError(estimator)

    def fit(setting):
        return lambda d: FAMILIES[estimator](d, cols, label, balanced=balanced, **setting)

    held_rows = _grid_scores(df, cols, label, grid, fold_col, folds, balanced) if estimator == "logistic" else None
    rows = []
    for i, setting in enumerate(grid):
        held = held_rows(i) if held_rows else _held_out(df, fit(setting), label, fold_col, None, folds, parallelism)[1]
        counts = M._score_counts(held, label, "score", [fold_col])
        auc = M._auc_from_counts(counts, [fold_col], "score", None).agg(F.avg("roc_auc")).first()[0]
        counts.unpersist()
        rows.append((i, str(sorted(setting.items())), auc))
    if held_rows:
        held_rows.rows.unpersist()
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "setting int, params string, roc_auc double")
    scored = [r for r in rows if r[2] is not None]
    best = max(scored, key=lambda r: (r[2], -r[0]))[0] if scored else 0
    return fit(grid[best])(df), table


class _GridScores:
    """Held-out class-1 probabilities of every setting: called with a setting's number,
    (fold, label, score) of all rows that some fold holds out."""

    def __init__(self, rows: DataFrame, cols, label, fold_col, stats, theta):
        self.rows, self.cols, self.label, self.fold_col = rows, cols, label, fold_col
        self.stats, self.theta = stats, theta  # per fold; per (fold, setting)

    def __call__(self, setting: int) -> DataFrame:
        margin = F.lit(None).cast("double")
        for k, (mean, dev) in enumerate(self.stats):
            *w, start = (float(t) for t in self.theta[k, setting])
            z = [(F.col(f"x{j}") - float(mean[j])) / float(dev[j]) * w[j] for j in range(len(w))]
            margin = F.when(F.col("fold") == k, reduce(lambda a, b: a + b, z) + start).otherwise(margin)
        d = self.rows.where(F.col("fold").between(0, len(self.stats) - 1))
        return d.select(F.col("fold").alias(self.fold_col), F.col("y").cast("int").alias(self.label), (1.0 / (1.0 + F.exp(-margin))).alias("score"))


def _newton_sums(sent, m: int):
    """Batches of (fold, y, x0..) -> one row: for every fold and setting the loss, gradient
    and curvature of the logistic objective over the fold's training rows, flattened."""
    a, b = np.triu_indices(m + 1)

    def run(batches):
        stats, weights, theta = sent.value
        total = np.zeros((len(stats), theta.shape[1], 1 + (m + 1) + len(a)))
        for batch in batches:
            fold, y = batch["fold"].to_numpy(), batch["y"].to_numpy(float)
            x = np.column_stack([batch[f"x{j}"].to_numpy(float) for j in range(m)])
            for k, (mean, dev) in enumerate(stats):
                own = fold != k
                t = y[own][:, None]
                z = np.column_stack([(x[own] - mean) / dev, np.ones(len(t))])
                w = np.where(t == 1, weights[k][1], weights[k][0])
                g = z @ theta[k].T
                e = np.exp(-np.abs(g))
                p = np.where(g >= 0, 1.0, e) / (1.0 + e)
                total[k, :, 0] += (w * (np.log1p(e) + np.maximum(g, 0.0) - t * g)).sum(0)
                total[k, :, 1:m + 2] += (w * (p - t)).T @ z
                total[k, :, m + 2:] += (w * p * (1.0 - p)).T @ (z[:, a] * z[:, b])
        yield pd.DataFrame({"sums": [total.ravel()]})
    return run


def _grid_scores(df: DataFrame, cols: Sequence[str], label: str, grid: Sequence[dict], fold_col: str,
                 folds: int, balanced: bool, max_iter: int = 100) -> _GridScores | None:
    """The logistic fits of all settings and folds at once, by Newton's method with step
    halving: a step is one pass over the rows for all of them, where fits of their own take
    a dozen passes or more each. The objective is ``fit_logistic``'s (scaler, class weights
    and penalty of a fold's own training rows), strictly convex, and solved to the last digits.

    None where fits of their own are needed: settings with other arguments than C and
    regParam, labels other than 0 and 1, missing features, a fold without both classes in
    its training rows, or a fit that does not settle."""
    if not cols or any(set(s) - {"C", "regParam"} or (s["regParam"] if s.get("regParam") is not None else 1 / s.get("C", 1.0)) <= 0 for s in grid):
        return None
    m = len(cols)
    x = [F.col(q(c)).cast("double").alias(f"x{j}") for j, c in enumerate(cols)]
    rows = df.where(F.col(fold_col).isNotNull()).select(F.col(fold_col).cast("long").alias("fold"), F.col(label).cast("double").alias("y"), *x)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    names = [f"x{j}" for j in range(m)]
    bad = reduce(lambda p, c: p | F.col(c).isNull() | F.isnan(c), names, F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0))
    aggs = [F.count_if(bad).alias("bad")]
    for k in range(folds):
        own = F.col("fold") != k
        aggs += [F.count_if(own & (F.col("y") == c)).alias(f"n{k}_{c}") for c in (0, 1)]
        aggs += [f(F.when(own, F.col(c))).alias(f"{n}{k}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = rows.agg(*aggs).first()
    n = [(r[f"n{k}_0"], r[f"n{k}_1"]) for k in range(folds)]
    if r["bad"] or not all(min(p) for p in n):
        rows.unpersist()
        return None
    stats = [(np.array([r[f"m{k}_{c}"] for c in names]), np.array([r[f"s{k}_{c}"] or 1.0 for c in names])) for k in range(folds)]
    weights = [tuple(sum(p) / (2.0 * c) for c in p) if balanced else (1.0, 1.0) for p in n]
    total = np.array([[float(sum(p))] * len(grid) for p in n])  # weights sum to the rows either way
    # the objective times the sum of weights: loss + penalty |beta|^2 / 2
    penalty = np.array([[1.0 / s.get("C", 1.0) if s.get("regParam") is None else s["regParam"] * sum(p) for s in grid] for p in n])
    theta = np.zeros((folds, len(grid), m + 1))
    theta[:, :, m] = np.array([math.log(p[1] * w[1] / (p[0] * w[0])) for p, w in zip(n, weights, strict=True)])[:, None]
    a, b = np.triu_indices(m + 1)

    def at(theta):
        sent = df.sparkSession.sparkContext.broadcast((stats, weights, theta))
        parts = rows.mapInPandas(_newton_sums(sent, m), "sums array<double>").collect()  # a row of sums per task
        sent.unpersist()
        s = np.sum([p["sums"] for p in parts], axis=0).reshape(folds, len(grid), -1)
        beta = np.concatenate([theta[..., :m], np.zeros((*theta.shape[:2], 1))], -1)
        curve = np.zeros((folds, len(grid), m + 1, m + 1))
        curve[..., a, b] = curve[..., b, a] = s[..., m + 2:]
        curve[..., range(m), range(m)] += penalty[..., None]
        return s[..., 0] + penalty / 2 * (beta * beta).sum(-1), s[..., 1:m + 2] + penalty[..., None] * beta, curve

    loss, slope, curve = at(theta)
    step, open_ = np.ones(loss.shape), np.ones(loss.shape, bool)
    for _ in range(max_iter):
        move = -np.linalg.solve(curve + 1e-12 * np.eye(m + 1), slope[..., None])[..., 0]
        gain = -(slope * move).sum(-1)  # twice what a full step gains on a parabola
        open_ &= gain > 1e-14 * np.maximum(loss, 1e-300)
        if not open_.any():
            return _GridScores(rows, cols, label, fold_col, stats, theta)
        then = np.where(open_[..., None], theta + step[..., None] * move, theta)
        found = at(then)
        good = found[0] <= loss - 1e-4 * step * gain + 1e-13 * np.abs(loss)
        if (~good & open_ & (step < 1e-8)).any() or not np.isfinite(found[0][good]).all():
            break
        take = good & open_
        theta = np.where(take[..., None], then, theta)
        loss, slope = np.where(take, found[0], loss), np.where(take[..., None], found[1], slope)
        curve = np.where(take[..., None, None], found[2], curve)
        step = np.where(take, 1.0, np.where(open_, step / 2, 1.0))
    rows.unpersist()
    return None


def tune_families(train: DataFrame, test: DataFrame, cols: Sequence[str], grids: dict,
                  label: str = "label", fold_col: str = "fold", key: str = "case_key",
                  parallelism: int = 4, folds: int = 5):
    """``grid_search`` of every family in ``grids`` (family -> settings) on ``train``, then
    one test row per family with its refitted best model: (models by family, metrics with
    the chosen params and their cross-validated ROC-AUC as ``cv_roc_auc``)."""
    models, chosen = {}, []
    for family, grid in grids.items():
        models[family], table = grid_search(train, cols, label, family, grid, fold_col, parallelism, folds)
        best = table.orderBy(F.col("roc_auc").desc_nulls_last(), "setting").first()
        chosen.append((family, best["params"], best["roc_auc"]))
    m = evaluate_models(train, test, {f: (lambda _, f=f: models[f]) for f in models}, label, key)
    spark = train.sparkSession
    return models, m.join(F.broadcast(spark.createDataFrame(chosen, "model string, params string, cv_roc_auc double")), "model")


# J4 ------------------------------------------------------------------------
def _sqdist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two double arrays, summed left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, v: acc + v)


def _cell_tree(sample: np.ndarray, n_cells: int) -> list[tuple]:
    """A k-d tree with about ``n_cells`` cells over a sample of vectors: nodes (feature,
    cut, left, right), or (cell,) at a leaf. A side holds x <= cut on the left. The cuts
    only balance the cells; exactness never depends on them."""
    nodes: list = [None]
    todo, cells = [(0, sample, n_cells)], 0
    while todo:
        at, rows, want = todo.pop()
        f, cut = 0, math.inf
        if want > 1 and len(rows) > 1:
            f = int(np.argmax(rows.max(0) - rows.min(0)))
            x = np.sort(rows[:, f])
            cut = float(x[(len(x) - 1) // 2])
            if cut == x[-1]:  # more than half at the top: cut below it
                below = x[x < cut]
                cut = float(below[-1]) if len(below) else math.inf
        if not math.isfinite(cut):
            nodes[at], cells = (cells,), cells + 1
            continue
        left = rows[:, f] <= cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        share = max(1, min(want - 1, round(want * float(left.mean()))))
        todo += [(nodes[at][2], rows[left], share), (nodes[at][3], rows[~left], want - share)]
    return nodes


def _cells_within(nodes: list[tuple], x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell that may hold a vector within squared distance ``bound``
    of a row. A box's distance is summed left to right like a vector's, so its rounding
    can never put it past a vector inside."""
    rows, cells = [], []
    d = x.shape[1]
    todo = [(0, np.arange(len(x)), np.full(d, -np.inf), np.full(d, np.inf))]
    while todo:
        at, idx, low, high = todo.pop()
        gap = np.maximum(np.maximum(low - x[idx], x[idx] - high), 0.0)
        idx = idx[np.cumsum(gap * gap, axis=1)[:, -1] <= bound[idx]]
        if not len(idx):
            continue
        node = nodes[at]
        if len(node) == 1:
            rows.append(idx)
            cells.append(np.full(len(idx), node[0]))
            continue
        f, cut, left, right = node
        todo += [(left, idx, low, np.where(np.arange(d) == f, cut, high)),
                 (right, idx, np.where(np.arange(d) == f, cut, low), high)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cells)


def _home_cells(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        at, idx = todo.pop()
        if len(nodes[at]) == 1:
            out[idx] = nodes[at][0]
        else:
            f, cut, left, right = nodes[at]
            under = x[idx, f] <= cut
            todo += [(left, idx[under]), (right, idx[~under])]
    return out


def _topk(Q: np.ndarray, T: np.ndarray, tie: np.ndarray, k: int):
    """(row of Q, row of T, squared distance) of the k nearest rows of T for every row of
    Q, nearest first. Candidates are screened with |q|^2 + |t|^2 - 2 q.t (one matrix
    product) widened by a bound on its rounding error, then ranked by the exact
    left-to-right sum of squared differences (tie: smaller ``tie``)."""
    qn, tn, kk = (Q * Q).sum(1), (T * T).sum(1), min(k, len(T))
    found = []
    for s0 in range(0, len(Q), 1024):
        Qc = Q[s0:s0 + 1024]
        approx = qn[s0:s0 + 1024, None] + tn[None, :] - 2.0 * (Qc @ T.T)
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        tol = 1e-9 * (qn[s0:s0 + 1024] + tn.max() + 1.0)
        r, c = np.nonzero(approx <= (kth + tol)[:, None])
        diff = T[c] - Qc[r]
        exact = np.cumsum(diff * diff, axis=1)[:, -1]
        order = np.lexsort((tie[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        keep = place < kk
        found.append((r[keep] + s0, c[keep], exact[keep]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _matrix(column, d: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, d))


def _home_search(k: int, sent, d: int):
    """Per (cell, part): the k nearest training rows of each test row in its own cell,
    the distance past which nothing can be nearer, and the other cells within it."""
    import pandas as pd

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty:
            return pd.DataFrame({"qid": [], "qv": [], "bound": [], "near": [], "cells": []}, dtype=object)
        Q, T = _matrix(q["qv"], d), _matrix(t["tv"], d)
        near: list[list] = [[] for _ in range(len(Q))]
        bound = np.full(len(Q), np.inf)
        if len(T):
            r, c, dist = _topk(Q, T, pd.factorize(t["tid"], sort=True)[0], k)
            tid, tl = t["tid"].tolist(), t["tl"].tolist()
            for i, j, x in zip(r.tolist(), c.tolist(), dist.tolist(), strict=True):
                near[i].append({"d": x, "tid": tid[j], "tl": None if pd.isna(tl[j]) else int(tl[j])})
            if len(T) >= k:
                bound[r] = dist  # ascending in a row: the last one stays, the k-th
        row, cell = _cells_within(sent.value, Q, bound)
        other = cell != q["cell"].to_numpy()[row]
        row, cell = row[other], cell[other]
        order = np.argsort(row, kind="stable")
        cells = np.split(cell[order], np.searchsorted(row[order], np.arange(1, len(Q))))
        return pd.DataFrame({"qid": q["qid"], "qv": q["qv"], "bound": bound, "near": near, "cells": [c.tolist() for c in cells]})
    return run


def _cell_search(k: int, d: int):
    """Per (cell, part): training rows of the cell that are within a test row's bound, at
    most the k nearest."""
    import pandas as pd

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"qid": [], "d": [], "tid": [], "tl": []}, dtype=object)
        r, c, dist = _topk(_matrix(q["qv"], d), _matrix(t["tv"], d), pd.factorize(t["tid"], sort=True)[0], k)
        near = dist <= q["bound"].to_numpy()[r]
        r, c, dist = r[near], c[near], dist[near]
        return pd.DataFrame({"qid": q["qid"].iloc[r].to_numpy(), "d": dist, "tid": t["tid"].iloc[c].to_numpy(), "tl": t["tl"].iloc[c].to_numpy()})
    return run


def _dealt(queries: DataFrame, train: DataFrame, n_cells: int, block_rows: int):
    """Both sides keyed by (cell, part): a cell with many test rows has as many parts as
    they need at ``block_rows`` each, and its training rows go to each part."""
    parts = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("long").alias("_parts"))
    parts = sized_broadcast(parts, known_rows=n_cells)
    q = queries.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("_parts"))).drop("_parts")
    t = train.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return q.groupBy("cell", "part"), t.groupBy("cell", "part")


def nearest_rows(train: DataFrame, test: DataFrame, k: int = 5, id_col: str = "id",
                 vec_col: str = "vec", label: str = "label", block_rows: int = 4096,
                 cell_rows: int = 1024, kept: list | None = None) -> DataFrame:
    """(qid, d, tid, tl): the k nearest training rows of every test row (squared
    Euclidean; distance ties → smaller train id). Ids may be of any type that orders.
    Rows whose vector is null or holds a null or a NaN are nobody's neighbour and have none.

    Exact, by cells of a k-d tree with about ``cell_rows`` training rows each, cut on a
    sample. Of training rows with one vector only the k smallest ids can be an answer,
    so no cell holds a value that many rows share. A test row first meets its own cell,
    whose k-th distance bounds the search, then only the cells whose box lies within
    that bound. In few dimensions these are a handful, whatever the size of the tables;
    in many they may be all, and the work is that of all pairs. Test rows of a cell go
    in parts of ``block_rows``, solved with NumPy. The two frames that are persisted on
    the way are appended to ``kept``, for the caller to release."""
    spark = train.sparkSession

    def side(df, prefix, *more):
        vec = F.transform(vec_col, lambda x: x.cast("double"))
        ok = F.col(vec_col).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))
        return df.where(ok).select(F.col(id_col).alias(prefix + "id"), vec.alias(prefix + "v"), *more)

    tr = side(train, "t", F.col(label).cast("int").alias("tl"))
    te = side(test, "q")
    n, distinct, d = tr.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("tv")), F.coalesce(F.max(F.size("tv")), F.lit(0))).first()
    want = max(1, min(math.ceil(min(n, k * distinct) / cell_rows), SAMPLED_NUMBERS // (16 * max(1, d))))
    rows = tr.select("tv").sample(False, min(1.0, 16 * want / n), 42).limit(20 * want).collect() if want > 1 else []
    nodes = _cell_tree(np.unique(np.array([r["tv"] for r in rows], float).reshape(-1, max(1, d)), axis=0), want)
    w = Window.partitionBy("tv").orderBy("tid")
    tr = tr.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    n_cells = sum(len(node) == 1 for node in nodes)
    sent = spark.sparkContext.broadcast(nodes)

    def placed(df, vec):
        def run(batches):
            for b in batches:
                yield b.assign(cell=_home_cells(sent.value, _matrix(b[vec], d)))
        return df.mapInPandas(run, StructType([*df.schema.fields, StructField("cell", LongType())]))

    tr = placed(tr, "tv").persist(StorageLevel.MEMORY_AND_DISK)
    tid, qid = (x.schema[c].dataType.simpleString() for x, c in ((tr, "tid"), (te, "qid")))
    q1, t1 = _dealt(placed(te, "qv"), tr, n_cells, block_rows)
    home = q1.cogroup(t1).applyInPandas(
        _home_search(k, sent, d), f"qid {qid}, qv array<double>, bound double, near array<struct<d:double,tid:{tid},tl:int>>, cells array<bigint>")
    home = home.persist(StorageLevel.MEMORY_AND_DISK)
    if kept is not None:
        kept += [tr, home]
    q2, t2 = _dealt(home.select("qid", "qv", "bound", F.explode("cells").alias("cell")), tr, n_cells, block_rows)
    schema = f"qid {qid}, d double, tid {tid}, tl int"
    cand = home.select("qid", F.explode("near").alias("n")).select("qid", "n.*") \
               .unionByName(q2.cogroup(t2).applyInPandas(_cell_search(k, d), schema))
    w = Window.partitionBy("qid").orderBy("d", "tid")
    return cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, id_col: str = "id",
                 vec_col: str = "vec", label: str = "label", block_rows: int = 4096
                 ) -> DataFrame:
    """Exact k-nearest-neighbour vote over ``nearest_rows`` (vote ties → smaller class;
    probability = the winner's votes / k)."""
    top = nearest_rows(train, test, k, id_col, vec_col, label, block_rows)
    votes = top.groupBy("qid", F.col("tl").alias("cls")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("qid").agg(F.max(F.struct("votes", (-F.col("cls")).alias("neg"))).alias("b"))
    return best.select(F.col("qid").alias(id_col), (-F.col("b.neg")).alias("predicted"),
                       (F.col("b.votes") / F.lit(float(k))).alias("probability"))


class NeighbourModel:
    """k nearest neighbours as a fitted model: training rows standardised by their own
    mean and deviation. Called on rows, it adds the share of class 1 among a row's
    nearest training rows, null for rows with a missing feature."""

    def __init__(self, train: DataFrame, cols: Sequence[str], label: str = "label",
                 key: str = "case_key", k: int = 5):
        self.stats = standard_stats(train, cols)
        self.label, self.key, self.k, self.kept = label, key, k, []
        self.train = self._vectors(train).select(key, "_vec", label)

    def _vectors(self, df: DataFrame) -> DataFrame:
        z = [((F.col(q(c)) - m) / s).cast("double") for c, (m, s) in self.stats.items()]
        return df.withColumn("_vec", F.array(*z))

    def __call__(self, df: DataFrame, out: str = "score") -> DataFrame:
        rows = self._vectors(df).select(self.key, "_vec")
        near = nearest_rows(self.train, rows, self.k, self.key, "_vec", self.label, kept=self.kept)
        share = near.groupBy(F.col("qid").alias("_near_key")).agg(F.avg((F.col("tl") == 1).cast("double")).alias("_share"))
        d = df.drop(out)
        return d.join(share, d[self.key] == F.col("_near_key"), "left") \
                .drop("_near_key").withColumnRenamed("_share", out)


def release(models: Sequence) -> None:
    """Frees what fitted models keep for scores that have been computed."""
    for m in models:
        while getattr(m, "kept", None):
            m.kept.pop().unpersist()


def fit_neighbours(df: DataFrame, cols: Sequence[str], label: str = "label",
                   key: str = "case_key", k: int = 5) -> NeighbourModel:
    return NeighbourModel(df, cols, label, key, k)
