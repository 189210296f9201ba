"""A training corpus from documents: toxic texts, exact and near copies go, sources
are mixed to target weights, and the rest is packed into sequences.

Each stage takes what its predecessor kept, written as Parquet and read again, and
returns the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from riskframe.llm.common import CLEANUP, materialise, shuffles_freed, table  # noqa: F401


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7 go; labels teach the score."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal without white space stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near copies stays: five-word shingles, Jaccard >= 0.8."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in gapless sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack)]

#: The last stage tokenizes and the first one learns, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. A stage is written before the next one begins, and so are
    the tables inside it, so a query's shuffle files go as soon as it has ended: waiting
    for the driver's garbage collector, they would pile up over the stages."""
    docs = table(spark, sf_dir, "documents")
    with shuffles_freed(spark):
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
