"""Streaming identity state: the status of each delivery, with the identities of the retention horizon.

The work is set-based: a micro-batch is joined with the stored identities that it mentions, so no id costs
a call and none is gathered in one place. Deliveries behind the horizon get their own status, and an
identity that has left the horizon no longer blocks its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.operators.features import RETENTION
from tidegate.streaming.pipeline import Pipeline


def identity_statuses(spark: SparkSession, stream: DataFrame, base: str, retention_us: int = RETENTION) -> DataFrame:
    """Statuses (seq, event_id, status) of all deliveries that the stream has; state stays below `base`."""
    pipeline = Pipeline(spark, base, "identity", retention_us, with_features=False)
    pipeline.run(stream, pipeline.on_events)
    return pipeline.table("statuses").select("seq", "event_id", "status")
