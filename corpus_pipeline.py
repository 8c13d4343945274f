"""A training-data pipeline: five stages over `documents`, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import mixing, nearcopies, surrogates, tiers, toxicity
from tidegate.llm.common import bounded, fold, table, written
from tidegate.llm.registry import SURROGATE_KEY, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below a half; the model learns from the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return bounded(docs).where(toxicity.score_of(spark, model)(fold()) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return nearcopies.one_of_each(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text."""
    found = surrogates.replaced(docs, SURROGATE_KEY)
    length = F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or up to three times."""
    return mixing.taken(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of several lengths, with their token ids."""
    return tiers.pack_documents(docs, vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("surrogates", replace_private),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No SQL states the models, hashes and draws of these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
