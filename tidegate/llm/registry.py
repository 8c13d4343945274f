"""The subpackage's registered queries: each operator applied to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, captures, chunks, embeddings, lm, merkle, mixing, oracles, packing, prefixes, simhash, surrogates, tiers, toxicity
from tidegate.llm.common import table


#: The registered queries' key; a production run brings its own secret.
SURROGATE_KEY = "registered query"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edits(table(spark, sf_dir, "documents"))


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_ids(table(spark, sf_dir, "documents"), vocabulary())


def op5_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_groups(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("component", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.withColumn("component_id", F.col("component")).drop("component")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.language_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replaced(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return found.select("doc_id", "n_entities", "kinds", "text")


def op11_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no time of capture: one second per id, from a fixed day on.
    at = (F.lit(1_704_067_200) + F.coalesce(F.pmod("page_id", F.lit(31_536_000)), F.lit(0))) * 1_000_000
    found = captures.captured(table(spark, sf_dir, "pages").withColumn("captured_us", at))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no")


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_fingerprints, op4_packed_ids, op5_tiered_packing, op6_embeddings, op7_simhash, op8_mixing, op9_language_scores, op10_surrogates, op11_captures, op12_prefixes, op13_manifest)}
ORACLES: dict[str, str] = oracles.ORACLES
