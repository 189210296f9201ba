"""Exact order statistics of many columns in two scans.

Scan 1 is one aggregate: moments and a mergeable quantile sketch per (group,
column). The sketch places every wanted rank between two values (a bracket), with a
rank error of at most 1/accuracy on either side. Scan 2 keeps values inside the
brackets as (value, count) and everything between brackets as one (count, least,
greatest), both combined on the map side. Together these rows are the exact
distribution at every wanted place, so quantiles come from them without a third
scan, and no row is ever sorted by value across the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..session import scratch_path

ACCURACY = 10_000


def _clean(name: str) -> Column:
    c = col(name).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Scan 1: (by, feature, n, mean, std, min, max, low, high): low and high are
    arrays of bracket ends, one per prob. Null and NaN are left out."""
    slack = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)]
    aggs = []
    for i, c in enumerate(cols):
        x = _clean(c)
        # an end that falls on the extreme rank is the extreme itself, whatever the sketch kept
        q = F.percentile_approx(x, ends, accuracy)
        fixed = [F.min(x) if e == 0.0 else F.max(x) if e == 1.0 else F.element_at(q, k + 1).cast("double") for k, e in enumerate(ends)]
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                             F.min(x).alias("min"), F.max(x).alias("max"), F.array(*fixed[0::2]).alias("low"), F.array(*fixed[1::2]).alias("high")).alias(f"_s{i}"))
    wide = df.groupBy(*[col(b) for b in by]).agg(*aggs) if by else df.agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(cols))])).alias("_s")).select(*by, "_s.*")


def bracketed(df: DataFrame, cols: Sequence[str], by: Sequence[str], brackets: dict[tuple, list[tuple[float, float]]]) -> DataFrame:
    """Scan 2: (by, feature, zone, value, c, least, most). Odd zones are brackets, with
    a row per value in them; even zones are the gaps around them, with one row each.

    ``brackets`` maps (group values ..., feature) to sorted, disjoint brackets; it has
    one entry per group and column, like the sketches it was read from.
    """
    groups: dict[tuple, dict[str, list]] = {}
    for key, found in brackets.items():
        groups.setdefault(key[:-1], {})[key[-1]] = found

    def zone(x: Column, found: list[tuple[float, float]]) -> Column:
        """Ends passed: a value on a low end is inside, and so is one on a high end."""
        return sum(((x >= F.lit(float(low))).cast("int") + (x > F.lit(float(high))).cast("int") for low, high in found), F.lit(0))

    pieces = []
    for c in cols:
        x = _clean(c)
        at = F.lit(0)
        for g, of in groups.items():
            own = zone(x, of.get(c, []))
            if by:
                same = F.lit(True)
                for name, v in zip(by, g, strict=True):
                    same = same & col(name).eqNullSafe(F.lit(v))
                at = F.when(same, own).otherwise(at)
            else:
                at = own
        pieces.append(F.struct(F.lit(c).alias("feature"), x.alias("x"), at.alias("zone")))
    rows = df.select(*[col(b) for b in by], F.explode(F.array(*pieces)).alias("_r")).where("_r.x IS NOT NULL")
    rows = rows.select(*by, "_r.feature", "_r.zone", "_r.x", F.when(F.col("_r.zone") % 2 == 1, F.col("_r.x")).alias("value"))
    return rows.groupBy(*by, "feature", "zone", "value").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))


def exact_distribution(df: DataFrame, cols: Sequence[str], by: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> tuple[DataFrame, DataFrame]:
    """(sketch rows with exact ``q`` (array, one per prob), bracketed rows with ``before``,
    the number of smaller rows) by (by, feature).

    Quantiles interpolate linearly between order statistics. One row per (group,
    column) reaches the driver. Should a sketch ever miss a rank, the brackets of its
    column widen to the whole range and the second scan is done again.
    """
    by = list(by)
    stats = sketches(df, cols, by, probs, accuracy)
    found = stats.collect()
    spark = df.sparkSession
    schema = stats.schema
    brackets = {}
    for r in found:
        if not r["n"]:
            continue
        own = list(zip(r["low"], r["high"], strict=True))
        brackets[(*[r[b] for b in by], r["feature"])] = _union(own)
    if not brackets:
        stats = spark.createDataFrame(found, schema)
        return stats.withColumn("q", F.lit(None).cast("array<double>")), _no_rows(stats, by)
    while True:
        rows = _written(bracketed(df, cols, by, brackets))
        order = Window.partitionBy(*by, "feature").orderBy("zone", "value")
        # gaps hold one row each and brackets a share of 4 / accuracy of the rows
        placed = rows.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # one row per (group, column), like the sketches: the answer itself is collected once
        got = {(*[r[b] for b in by], r["feature"]): list(r["q"]) for r in _quantiles(placed, by, probs).collect()}
        missed = [k for k, q in got.items() if None in q]
        if not missed:
            answer = [(*r, got.get((*[r[b] for b in by], r["feature"]))) for r in found]
            return spark.createDataFrame(answer, T.StructType([*schema.fields, T.StructField("q", T.ArrayType(T.DoubleType()))])).coalesce(1), placed
        for key in missed:
            brackets[key] = [(float("-inf"), float("inf"))]


def _written(df: DataFrame) -> DataFrame:
    """df written to the shared folder: read several times without a cache to release."""
    path = scratch_path(df.sparkSession, "brackets")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _union(found: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(found):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _no_rows(stats: DataFrame, by: list[str]) -> DataFrame:
    none = stats.where("false").select(*by, "feature")
    return none.selectExpr("*", "0 AS zone", "0D AS value", "0L AS c", "0D AS least", "0D AS most", "0L AS before")


def _quantiles(placed: DataFrame, by: list[str], probs: Sequence[float]) -> DataFrame:
    """(by, feature, q): the exact quantiles, null where a rank is not inside a bracket."""
    keys = [*by, "feature"]
    rank = lambda p, n: (n - 1) * F.lit(float(p))
    n = F.sum("c").over(Window.partitionBy(*keys))
    d = placed.withColumn("_n", n)
    wanted = {}
    for i, p in enumerate(probs):
        for name, r in ((f"f{i}", F.floor(rank(p, F.col("_n")))), (f"c{i}", F.ceil(rank(p, F.col("_n"))))):
            wanted[name] = F.max(F.when((F.col("zone") % 2 == 1) & (r >= F.col("before")) & (r < F.col("before") + F.col("c")), F.col("value"))).alias(name)
    q = []
    for i, p in enumerate(probs):
        h = rank(p, F.col("_n"))
        q.append(F.col(f"f{i}") + (F.col(f"c{i}") - F.col(f"f{i}")) * (h - F.floor(h)))
    return d.groupBy(*keys).agg(F.max("_n").alias("_n"), *wanted.values()).select(*keys, F.array(*q).alias("q"))
