"""Projection helpers: label split, renames, unpivot, arrays to
named columns, column checks. All of them are metadata-only or single
projections; none starts a job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def q(name: str) -> str:
    """Back-quote a column name (names with spaces are common here)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


# A2 ------------------------------------------------------------------------
def feature_columns(df: DataFrame, target: str | None = None,
                    ids: Iterable[str] = ()) -> list[str]:
    """Every numeric column except the target and id columns (schema only)."""
    skip = set(ids) | ({target} if target else set())
    return [f.name for f in df.schema.fields
            if f.name not in skip and isinstance(f.dataType, NUMERIC)]


# B1 / B2 -------------------------------------------------------------------
def split_features_label(df: DataFrame, label: str, ids: Sequence[str] = ()):
    """(features-with-ids, label-with-ids): two projections of one scan."""
    feats = [c for c in df.columns if c != label]
    return df.select(*[col(c) for c in feats]), df.select(*[col(c) for c in ids], col(label))


def with_label(df: DataFrame, label_col: Column, name: str = "label") -> DataFrame:
    return df.withColumn(name, label_col)


# B4 ------------------------------------------------------------------------
def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


# B5 ------------------------------------------------------------------------
def unpivot_features(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                     var: str = "feature", value: str = "value") -> DataFrame:
    """Melt to (ids..., feature, value); values are cast to double."""
    base = df.select(*[col(c) for c in ids],
                     *[col(c).cast("double").alias(c) for c in values])
    return base.unpivot([col(c) for c in ids], [col(c) for c in values], var, value)


# B8 ------------------------------------------------------------------------
def vector_to_columns(df: DataFrame, arr: str, names: Sequence[str],
                      keep: Sequence[str] = ()) -> DataFrame:
    """Positional array → named columns (``arr[i] AS names[i]``)."""
    a = col(arr)
    return df.select(*[col(c) for c in keep],
                     *[a.getItem(i).cast("double").alias(n) for i, n in enumerate(names)])


def columns_to_vector(names: Sequence[str]) -> Column:
    return F.array(*[col(n).cast("double") for n in names])


# B9 / H3 -------------------------------------------------------------------
def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], what: str = "data") -> DataFrame:
    miss = missing_columns(df, required)
    if miss:
        raise ValueError(f"Missing required columns in {what}: {miss}")
    return df


# Output normalisation used by the query catalogue --------------------------
def round_doubles(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every float column to ``digits`` as ``round(x * 10^d) / 10^d``
    (the same IEEE steps in any SQL engine, so two engines that computed the
    same double print the same rounded double; ties round away from zero)."""
    out = []
    scale = float(10 ** digits)
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            r = F.round(c.cast("double") * scale, 0) / scale
            # -0.0 prints differently from 0.0: fold it into 0.0
            out.append(F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("long").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
