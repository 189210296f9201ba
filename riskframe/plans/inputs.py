"""Role tables built from the driver's test tables.

Each builder is a plain projection of one table: it only gives rows in the
schema an operator expects and does none of the operator's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def score_expr():
    """Exact arithmetic stand-in for a model probability (0.008..0.923)."""
    return F.round((F.col("l_quantity") * 2 + F.col("l_discount") * 1000
                    + F.col("l_tax") * 500) / 260.0, 4)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a labelled feature table: unique case key, four numeric
    features, label = returned ('R'), an arithmetic score, line status."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("case_key"),
        *FEATURES,
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score_expr().alias("score"),
        "l_linestatus",
    )


LABELLED_SQL = """lab AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS case_key,
         l_quantity, l_extendedprice, l_discount, l_tax,
         CAST(l_returnflag = 'R' AS INTEGER) AS label,
         round((l_quantity * 2 + l_discount * 1000 + l_tax * 500) / 260.0, 4) AS score,
         l_linestatus
  FROM lineitem)"""


# Model variants: alternative arithmetic scores over the same rows, used as
# the "models" of ranking and comparison operators.
MODEL_SCORES = {
    "arith": "round((l_quantity * 2 + l_discount * 1000 + l_tax * 500) / 260.0, 4)",
    "discount": "round(l_discount * 10, 4)",
    "quantity": "round(l_quantity / 50.0, 4)",
    "price": "round(l_extendedprice / 105000.0, 4)",
}


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scored table (model, case_key, label, score) from ONE scan:
    each row is expanded to one row per model by an array of structs."""
    lab = labelled(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("s"))
                    for m, e in MODEL_SCORES.items()])
    return (lab.select("case_key", "label", F.explode(arr).alias("m"))
               .select(F.col("m.model").alias("model"), "case_key", "label",
                       F.col("m.s").alias("score")))


SCORED_MODELS_SQL = "sm AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS case_key, "
    f"CAST(l_returnflag = 'R' AS INTEGER) AS label, CAST({e} AS DOUBLE) AS score FROM lineitem"
    for m, e in MODEL_SCORES.items()) + ")"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lineitem with a planted label that is a known function of two
    features (discount*10 + tax*10 > 0.9), for model-recovery queries. The rows are
    dealt over the cores: fits read them many times."""
    lab = spread(labelled(spark, sf_dir), table(spark, sf_dir, "lineitem").count())
    return lab.withColumn("label", ((F.col("l_discount") * 10 + F.col("l_tax") * 10) > 0.9)
                          .cast("int"))
