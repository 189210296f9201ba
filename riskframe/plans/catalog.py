"""Registry of named queries over the test tables, each with its DuckDB twin.

A query is ``fn(spark, sf_dir) -> DataFrame``; the twin is ANSI SQL over the
same parquet tables, or ``None`` when the operator is not SQL-expressible
(model fitting, sampling generators) and is checked by tests instead.
Doubles are rounded to 6 digits and integers widened to BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")

        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        REGISTRY[name] = (wrapped, sql)
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import (q_metrics, q_models, q_profile, q_records, q_sampling,  # noqa: F401
                   q_select, q_explain)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def _wrap(sql: str, doubles: list[str], longs: list[str]) -> str:
    """Apply the Spark side's output normalisation to the DuckDB twin: doubles
    as round(x * 1e9) / 1e9, integers widened to BIGINT."""
    r = 'round(CAST("{c}" AS DOUBLE) * CAST(1000000000 AS DOUBLE)) / CAST(1000000000 AS DOUBLE)'
    reps = [f'CASE WHEN {r.format(c=c)} = 0 THEN CAST(0 AS DOUBLE) ELSE {r.format(c=c)} END AS "{c}"'
            for c in doubles]
    reps += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in longs]
    if not reps:
        return sql
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{sql.strip()}\n) AS _oracle"


def oracle_sql() -> dict[str, str]:
    _load_all()
    try:
        from ._schema_hints import HINTS
    except ImportError:  # before the first generation
        HINTS = {}
    out = {}
    for k, (_, sql) in REGISTRY.items():
        if sql:
            d, l = HINTS.get(k, ([], []))
            out[k] = _wrap(sql, d, l)
    return out
