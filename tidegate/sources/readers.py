"""Scans: every reader names its columns, so a file never decides its own schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate import schemas
from tidegate.functions.scalars import payload_hash
from tidegate.functions.times import micros
from tidegate.operators.features import FEATURE_VERSION
from tidegate.operators.quality import content_hash


def scan_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).parquet(f"{folder}/events.parquet")


def scan_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The table with its declared schema, after the files' own schema was compared with it."""
    schemas.validate(spark.read.parquet(path), schemas.TRANSACTIONS)
    return spark.read.schema(schemas.TRANSACTIONS).parquet(path)


def to_events(txns: DataFrame) -> DataFrame:
    """Raw transactions as feature history with their payload hash."""
    columns = ["transaction_id", "customer_id", "terminal_id", "amount_minor", "currency", "event_us"]
    return txns.select(
        F.col("transaction_id").alias("event_id"),
        "customer_id",
        "terminal_id",
        "amount_minor",
        "event_us",
        "received_us",
        payload_hash(*[F.col(c) for c in columns]).alias("payload_hash"),
        F.col("transaction_id").alias("source_id"),
    )


def with_micros(df: DataFrame, **columns: str) -> DataFrame:
    """Epoch microseconds from timestamp columns, as `new=old`."""
    return df.withColumns({new: micros(old) for new, old in columns.items()})


def csv_source(spark: SparkSession, path: str, columns: list[str], **casts: str) -> DataFrame:
    """A CSV file with a header, read as text and cast afterwards."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    text = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return text.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in columns])


class DatasetMismatch(ValueError):
    """A derived table does not belong to its source, version or manifest."""


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def scan_derived(spark: SparkSession, path: str, source_digest: str) -> DataFrame:
    """Derived features, after their manifest was checked against the source and the content."""
    manifest = read_manifest(spark, path)
    data = spark.read.parquet(f"{path}/data")
    if manifest["source_digest"] != source_digest:
        raise DatasetMismatch("derived from another source")
    if manifest["feature_version"] != FEATURE_VERSION:
        raise DatasetMismatch(f"feature version {manifest['feature_version']}")
    if content_hash(data).first()["digest"] != manifest["digest"]:
        raise DatasetMismatch("content differs from the manifest")
    return data


def verify(spark: SparkSession, path: str) -> list[str]:
    """Problems of a written table against its manifest; empty when there are none."""
    manifest = read_manifest(spark, path)
    found = content_hash(spark.read.parquet(f"{path}/data")).first()
    problems = []
    if found["rows"] != manifest["rows"]:
        problems.append(f"rows: {found['rows']} instead of {manifest['rows']}")
    if found["digest"] != manifest["digest"]:
        problems.append("content hash mismatch")
    return problems


def message_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Messages of a Kafka topic from the start, only committed ones (needs the connector jar)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("includeHeaders", "true")
        .option("kafka.isolation.level", "read_committed")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
        .select("key", "value", "headers", "topic", "partition", "offset")
    )


def message_files(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The same columns from a folder of Parquet files."""
    return spark.readStream.schema(schemas.MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def relational(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ranges of its key (needs the driver jar)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        .load()
    )
