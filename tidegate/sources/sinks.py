"""Writers: write-once tables, idempotent inserts, published messages, append-only reviews."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidegate.operators.decide import first_requests, review_problem
from tidegate.operators.features import FEATURE_VERSION
from tidegate.operators.quality import content_hash


class AlreadyWritten(ValueError):
    """Write-once data exists at the target."""


class InvalidReview(ValueError):
    """A review that may not be appended."""


def manifest_columns(rows: DataFrame, shares: dict[str, Column] | None = None) -> DataFrame:
    """Rows, content digest and shares of boolean flags, from aggregates that combine early."""
    out = content_hash(rows)
    for name, flag in (shares or {}).items():
        share = rows.agg(F.avg(flag.cast("int")).alias("s")).scalar()
        out = out.withColumn(name, share)
    return out


def write_once(rows: DataFrame, path: str, **manifest: object) -> dict:
    """Write data and manifest; refuse a target that has either."""
    try:
        rows.write.mode("errorifexists").parquet(f"{path}/data")
    except AnalysisException as exc:
        raise AlreadyWritten(path) from exc
    spark = rows.sparkSession
    found = content_hash(spark.read.parquet(f"{path}/data")).first()
    document = {"rows": found["rows"], "digest": found["digest"], "feature_version": FEATURE_VERSION, **manifest}
    line = json.dumps(document, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return document


def classify_inserts(
    incoming: DataFrame, stored: DataFrame, key: str, payload: str, order: list[str]
) -> DataFrame:
    """Verdict per incoming row against the stored rows: new, replay or conflict.

    Only the first row of an id can be new, and only when nothing is stored under it.
    """
    known = stored.select(key, F.col(payload).alias("_stored"))
    firsts = first_requests(incoming, key, payload, order).join(known, key, "left")
    verdict = (
        F.when(F.col("_stored").isNull(), F.col("verdict"))
        .when(F.col("_stored") == F.col(payload), F.lit("replay"))
        .otherwise(F.lit("conflict"))
    )
    return firsts.withColumn("verdict", verdict).drop("_stored")


def insert_new(classified: DataFrame, path: str) -> None:
    """Append the new rows of one batch as that batch's folder, replaced when the batch is repeated."""
    classified.filter(F.col("verdict") == "new").drop("verdict").write.mode("overwrite").parquet(path)


def append_reviews(reviews: DataFrame, decisions: DataFrame, path: str) -> None:
    """Append reviews of known decisions; nothing is ever updated, and one bad row refuses all."""
    checked = reviews.join(
        decisions.select("transaction_id").distinct().withColumn("_known", F.lit(True)), "transaction_id", "left"
    )
    problem = F.when(F.col("_known").isNull(), F.lit("NOT_FOUND")).otherwise(
        review_problem(F.col("status"), F.col("disposition"), F.col("note"))
    )
    bad = checked.select(problem.alias("p")).filter("p IS NOT NULL").first()
    if bad is not None:
        raise InvalidReview(bad["p"])
    reviews.write.mode("append").parquet(path)


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """Messages to a Kafka topic (needs the connector jar)."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option(
        "includeHeaders", "true"
    ).save()
