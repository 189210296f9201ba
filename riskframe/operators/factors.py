"""Exact per-case factors in one narrow pass.

Interventional Shapley values against a bounded background, in closed form:

* additive scorers: weight * (value - mean of the background), per term;
* trees and forests: per leaf. A leaf's path is an interval per feature it tests.
  With S the features where only the case is inside and T those where only the
  background row is, the leaf adds value * (|S|-1)! |T|! / (|S|+|T|)! to each
  feature of S and takes value * |S|! (|T|-1)! / (|S|+|T|)! from each of T; where
  a feature has neither inside the leaf adds nothing. Forests average their trees.

A case's factors depend on that case and the model alone, so every scored row gets
them without a shuffle: the model's leaves and the background (at most
``MAX_BACKGROUND`` rows) go to the tasks once. Factors stay in the row as an array
of (feature, value, shap_value) in order of the features; ``top_of`` and ``bars_of``
are functions of that array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.columns import col
from ..session import scratch_path
from .explain import BAR_FLOOR, TOP_N

MAX_BACKGROUND = 1000
MAX_GRID = 4_000_000  # numbers in a forest's tables over the cells between its cuts
FACTORS = "array<struct<feature:string,value:double,shap_value:double>>"


def background_rows(background: DataFrame, features: Sequence[str]) -> np.ndarray:
    """The background as a matrix; refused when empty or larger than the bound."""
    rows = background.select(*[col(f).cast("double") for f in features]).limit(MAX_BACKGROUND + 1).collect()
    if not rows:
        raise ValueError("empty background")
    if len(rows) > MAX_BACKGROUND:
        raise ValueError(f"background has more than {MAX_BACKGROUND} rows; sample it first")
    return np.array([[np.nan if v is None else v for v in r] for r in rows], float)


def linear_factors(df: DataFrame, background: DataFrame, weights: dict[str, float], out: str = "factors") -> DataFrame:
    """df with the factors of an additive scorer sum(w * x) + c. A missing value has a
    null factor."""
    means = np.nanmean(background_rows(background, list(weights)), axis=0)
    terms = [F.struct(F.lit(f).alias("feature"), col(f).cast("double").alias("value"),
                      (F.lit(float(w)) * (col(f).cast("double") - F.lit(float(m)))).alias("shap_value"))
             for (f, w), m in zip(weights.items(), means, strict=True)]
    return df.withColumn(out, F.array(*terms))


# Trees -----------------------------------------------------------------------
def leaf_boxes(pipeline) -> tuple[list[list[tuple[dict[int, tuple[float, float]], float]]], np.ndarray, np.ndarray]:
    """([leaves of each tree], means, deviations) of a fitted tree or forest pipeline:
    a leaf is ({feature: (low, high]} on standardised features, class-1 share)."""
    from pyspark.ml.classification import DecisionTreeClassificationModel

    from .models import standardised_columns, standardised_moments
    last = pipeline.stages[-1]
    if not hasattr(last, "featureImportances"):
        raise ValueError("closed-form factors are of trees and forests; use permutation_shap for other models")
    trees = [last] if isinstance(last, DecisionTreeClassificationModel) else last.trees
    out = [_leaves(nodes) for nodes in _tree_nodes(last, len(trees))]
    moments = standardised_moments(pipeline)
    names = standardised_columns(pipeline)
    return out, np.array([moments[n][0] for n in names]), np.array([moments[n][1] for n in names])


def _tree_nodes(model, n_trees: int) -> list[dict]:
    """Per tree {node id: (class counts, left, right, feature, cut)}, as the model writes
    itself: one job, in place of calls to the driver's JVM for every node."""
    spark = model.sparkSession if hasattr(model, "sparkSession") else SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    d = spark.read.parquet(f"{path}/data")
    node = "nodeData" if "nodeData" in d.columns else None
    at = (lambda c: F.col(f"{node}.{c}")) if node else F.col
    tree = F.col("treeID") if "treeID" in d.columns else F.lit(0)
    rows = d.select(tree.cast("int").alias("tree"), at("id").alias("id"), at("impurityStats").alias("stats"), at("leftChild").alias("left"), at("rightChild").alias("right"),
                    at("split.featureIndex").alias("feature"), F.get(at("split.leftCategoriesOrThreshold"), F.lit(0)).alias("cut")).collect()
    out: list[dict] = [{} for _ in range(n_trees)]
    for r in rows:
        out[r["tree"]][r["id"]] = (r["stats"], r["left"], r["right"], r["feature"], r["cut"])
    return out


def _leaves(nodes: dict) -> list[tuple[dict[int, tuple[float, float]], float]]:
    leaves, todo = [], [(0, {})]  # the root's id is 0
    while todo:
        at, box = todo.pop()
        stats, left, right, f, cut = nodes[at]
        if left < 0:
            leaves.append((box, stats[1] / sum(stats) if sum(stats) else 0.0))
            continue
        low, high = box.get(f, (-np.inf, np.inf))  # standardised features are continuous: every split has a threshold
        todo.append((left, {**box, f: (low, min(high, cut))}))
        todo.append((right, {**box, f: (max(low, cut), high)}))
    return leaves


def _signs(x: np.ndarray, box: dict[int, tuple[float, float]]) -> np.ndarray:
    """For every row a bit per tested feature: inside the leaf's interval."""
    code = np.zeros(len(x), np.int64)
    for bit, (f, (low, high)) in enumerate(box.items()):
        code |= ((x[:, f] > low) & (x[:, f] <= high)).astype(np.int64) << bit
    return code


def tree_shap(x: np.ndarray, background: np.ndarray, trees: list) -> np.ndarray:
    """Factors (rows by features) of standardised rows; trees as ``leaf_boxes`` gives them."""
    phi = np.zeros((len(x), x.shape[1] if x.ndim == 2 else 0))
    for leaves in trees:
        for box, share in leaves:
            d = len(box)
            if not share or not d:
                continue
            full, fs = (1 << d) - 1, list(box)
            there, counts = np.unique(_signs(background, box), return_counts=True)
            here, which = np.unique(_signs(x, box), return_inverse=True)
            part = np.zeros((len(here), d))
            for i, a in enumerate(here.tolist()):
                for b, n in zip(there.tolist(), counts.tolist(), strict=True):
                    if (a | b) != full or a == b:
                        continue  # neither is inside somewhere, or the case changes nothing
                    mine, other = a & ~b, b & ~a
                    s, t = mine.bit_count(), other.bit_count()
                    whole = factorial(s + t)
                    up = factorial(s - 1) * factorial(t) / whole if s else 0.0
                    down = factorial(s) * factorial(t - 1) / whole if t else 0.0
                    for bit in range(d):
                        if mine >> bit & 1:
                            part[i, bit] += n * up
                        elif other >> bit & 1:
                            part[i, bit] -= n * down
            phi[:, fs] += (part * (share / len(background)))[which]
    return phi / max(1, len(trees))


def grid_tables(background: np.ndarray, trees: list, n_features: int):
    """(cuts of each feature, {features: table}): all trees together as one table over the
    cells between their cuts, and for every set of features the mean over the background of
    that table with the other features as the background row has them. None where the
    tables would hold more than ``MAX_GRID`` numbers."""
    bounds: list[set] = [set() for _ in range(n_features)]
    boxes = [(box, share) for leaves in trees for box, share in leaves if share]
    for box, _ in boxes:
        for f, sides in box.items():
            bounds[f].update(b for b in sides if np.isfinite(b))
    cuts = [np.array(sorted(b), float) for b in bounds]
    widths = [len(c) + 1 for c in cuts]
    if n_features > 10 or math.prod(w + 1 for w in widths) > MAX_GRID:
        return None
    first, end = np.zeros((len(boxes), n_features), np.int64), np.tile(np.array(widths), (len(boxes), 1))
    for i, (box, _) in enumerate(boxes):
        for f, (low, high) in box.items():
            if np.isfinite(low):
                first[i, f] = np.searchsorted(cuts[f], low) + 1
            if np.isfinite(high):
                end[i, f] = np.searchsorted(cuts[f], high) + 1
    share = np.array([s for _, s in boxes]) / max(1, len(trees))
    whole = np.zeros([w + 1 for w in widths])  # a leaf's box by its corners
    for corner in range(1 << n_features):
        at = tuple(np.where(corner >> f & 1, end[:, f], first[:, f]) for f in range(n_features))
        np.add.at(whole, at, -share if corner.bit_count() % 2 else share)
    for f in range(n_features):
        np.cumsum(whole, axis=f, out=whole)
    whole = whole[tuple(slice(w) for w in widths)]
    there = [np.searchsorted(c, background[:, f], "left") for f, c in enumerate(cuts)]
    tables = {}
    for code in range(1 << n_features):
        own = tuple(f for f in range(n_features) if code >> f & 1)
        tables[own] = sum(whole[tuple(slice(None) if f in own else there[f][z] for f in range(n_features))] for z in range(len(background))) / len(background)
    return cuts, tables


def grid_shap(x: np.ndarray, cuts: list[np.ndarray], tables: dict) -> np.ndarray:
    """Factors of standardised rows from ``grid_tables``: the weighted gains of each feature
    over the sets without it, a lookup per set and row. Equal to ``tree_shap``."""
    m = len(cuts)
    at = [np.searchsorted(c, np.nan_to_num(x[:, f]), "left") for f, c in enumerate(cuts)]
    value = {own: np.broadcast_to(t[tuple(at[f] for f in own)], len(x)) for own, t in tables.items()}
    phi = np.zeros((len(x), m))
    for own, v in value.items():
        size = len(own)
        for f in range(m):
            if f in own:
                phi[:, f] += v * (factorial(size - 1) * factorial(m - size) / factorial(m))
            else:
                phi[:, f] -= v * (factorial(size) * factorial(m - size - 1) / factorial(m))
    return phi


def tree_factors(df: DataFrame, background: DataFrame, pipeline, out: str = "factors") -> DataFrame:
    """df with the factors of a fitted tree or forest for every row, in one narrow pass.

    Factors and the background's mean probability add up to the row's probability. A
    row with a missing feature has no factors (null). Batches are Arrow batches; the
    tables of ``grid_tables`` are sent to the tasks once, or the leaves where those would
    be too large.
    """
    from .models import standardised_columns
    features = standardised_columns(pipeline)
    trees, mean, dev = leaf_boxes(pipeline)
    base = (background_rows(background, features) - mean) / dev
    if np.isnan(base).any():
        raise ValueError("the background has missing values")
    grid = grid_tables(base, trees, len(features))
    sent = df.sparkSession.sparkContext.broadcast((None if grid else trees, base, grid))
    own = [c for c in df.columns if c != out]
    d = df.select(*[col(c) for c in own], F.array(*[col(f).cast("double") for f in features]).alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, base, grid = sent.value
        m = len(features)
        for batch in batches:
            x = batch.column(batch.schema.names.index(out)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, m)
            z = (x - mean) / dev
            phi = grid_shap(z, *grid) if grid else tree_shap(z, base, trees)
            one = pa.StructArray.from_arrays([pa.array(np.tile(np.array(features, object), len(x)), pa.string()), pa.array(x.ravel()), pa.array(phi.ravel())],
                                             ["feature", "value", "shap_value"])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(x) + 1, m), pa.int32()), one, mask=pa.array(np.isnan(x).any(axis=1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(own))], rows], [*own, out])
    schema = df.select(*[col(c) for c in own]).schema.add(out, _type(FACTORS))
    return d.mapInArrow(run, schema)


def _type(ddl: str):
    from pyspark.sql.types import _parse_datatype_string
    return _parse_datatype_string(ddl)


# Functions of the factors of a row ---------------------------------------------
def ranked(factors: Column, n: int = TOP_N) -> Column:
    """The n strongest by |shap_value| (ties by feature), in that order."""
    key = F.transform(factors, lambda s: F.struct((-F.abs(s["shap_value"])).alias("by"), s["feature"].alias("feature"),
                                                  s["value"].alias("value"), s["shap_value"].alias("shap_value")))
    return F.slice(F.array_sort(key), 1, n)


def top_of(factors: Column, n: int = TOP_N) -> Column:
    """Array of (feature, value, shap_value, direction): values to 5 digits, half-even."""
    return F.transform(ranked(factors, n), lambda s: F.struct(
        s["feature"].alias("feature"), F.bround(s["value"], 5).alias("value"), F.bround(s["shap_value"], 5).alias("shap_value"),
        S.shap_direction(s["shap_value"]).alias("direction")))


def bars_of(factors: Column) -> Column:
    """Array of (feature, label, bar_pct): |shap| in percent of the row's largest (at least the floor)."""
    most = F.greatest(F.array_max(F.transform(factors, lambda s: F.abs(s["shap_value"]))), F.lit(BAR_FLOOR))
    return F.transform(factors, lambda s: F.struct(
        s["feature"].alias("feature"), S.feature_label(s["feature"]).alias("label"),
        F.least(F.abs(s["shap_value"]) / most * 100, F.lit(100.0)).alias("bar_pct")))


def long_factors(df: DataFrame, key: str, factors: str = "factors") -> DataFrame:
    """(key, feature, value, shap_value): one row per case and feature."""
    return df.select(key, F.explode(factors).alias("_f")).select(key, "_f.*")


def long_top(df: DataFrame, key: str, factors: str = "factors", n: int = TOP_N) -> DataFrame:
    """(key, rank, feature, value, shap_value, direction) of the n strongest."""
    return (df.select(key, F.posexplode(top_of(F.col(factors), n)).alias("_at", "_f"))
            .select(key, (F.col("_at") + 1).cast("long").alias("rank"), "_f.*"))


def long_bars(df: DataFrame, key: str, factors: str = "factors") -> DataFrame:
    return df.select(key, F.explode(bars_of(F.col(factors))).alias("_f")).select(key, "_f.*")
