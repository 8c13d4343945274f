"""Queries over streams with keyed state."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidegate import schemas
from tidegate.catalog.base import DAY_US, query
from tidegate.catalog.pit import _DAY0, _STATUS, feature_sql
from tidegate.fixtures import load
from tidegate.functions.times import DAY, lit
from tidegate.operators import apply as ap
from tidegate.operators.features import FEATURES, RETENTION
from tidegate.operators.splits import first_day
from tidegate.session import scratch
from tidegate.streaming import keyed


def _layout(rows):
    """Partitions of the state and groups of its keys.

    One partition for each core where there are rows for it, more where a partition would be large; about 10,000 rows
    to a group, and groups enough to fill the partitions evenly."""
    workers, n = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    partitions = max(4, min(workers, math.ceil(n / 10_000)), math.ceil(n / 1_000_000))
    return partitions, max(8 * partitions, math.ceil(n / 10_000))


def _stream(spark, rows, path, parts, width_us):
    """A stream of one file per span of arrival, which becomes one micro-batch each."""
    names = schemas.TXN_EVENT.fieldNames()
    rows = rows.select(*names).checkpoint()
    start = rows.agg(F.min("received_us")).first()[0]
    for part in range(parts):
        low, high = start + part * width_us, start + (part + 1) * width_us
        inside = (F.col("received_us") >= low) & ((F.col("received_us") < high) | F.lit(part == parts - 1))
        rows.filter(inside).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schemas.TXN_EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


_SHOWN = f"f.seq, statuses.status, f.decision_us, {', '.join('f.' + name for name in FEATURES)}, TRUE AS history_complete"


@query(
    "str2_keyed_features",
    f"SELECT {_SHOWN} FROM f JOIN statuses ON statuses.seq = f.seq",
    ("deliveries",),
    {**_STATUS, "f": feature_sql("statuses", applied="status = 'applied'")},
)
def str2_keyed(spark, folder):
    """STR-2, STATE-1, STATE-3: statuses and features of five batches by keyed state, equal to the batch result."""
    path = scratch(spark, "keyed")
    rows = load(spark, folder, "deliveries")
    stream = _stream(spark, rows, path, 5, 7 * DAY)
    partitions, groups = _layout(rows)
    keyed.run_keyed(keyed.keyed_features(stream, groups=groups), path, partitions)
    return spark.read.parquet(f"{path}/out").select("seq", "status", "decision_us", *FEATURES, "history_complete")


_WIDE = {
    **_STATUS,
    # Twice as far apart, so that the history is longer than the horizon.
    "wide": """SELECT event_id, customer_id, terminal_id, status, nth, event_us * 2 - (SELECT min(event_us) FROM history) AS event_us,
                      received_us * 2 - (SELECT min(event_us) FROM history) AS received_us FROM statuses""",
    "parts": f"""SELECT *, least((received_us - (SELECT min(received_us) FROM wide)) // (12 * {DAY_US}), 4) AS part FROM wide""",
    "marks": f"""SELECT b.batch, max(p.event_us) // 1000 - {RETENTION // 1000} AS mark_ms
                 FROM (SELECT CAST(range AS BIGINT) AS batch FROM range(6)) b LEFT JOIN parts p ON p.part < b.batch GROUP BY b.batch""",
    "held": "SELECT m.batch, m.mark_ms, p.* FROM marks m JOIN parts p ON p.part <= m.batch AND (p.status = 'applied' OR p.nth = 1)",
}


def _days(kind: str, entity: str) -> str:
    return f"""SELECT batch, '{kind}' AS kind, count(DISTINCT ({entity}, event_us // {DAY_US})) AS kept
               FROM held WHERE status = 'applied' AND (mark_ms IS NULL OR (event_us // {DAY_US} + 1) * {DAY_US // 1000} > mark_ms) GROUP BY batch"""


@query(
    "state7_records_by_batch",
    f"""SELECT CAST(batch AS INTEGER) AS batch, kind, kept FROM (
        SELECT batch, 'ids' AS kind, count(*) AS kept FROM held WHERE mark_ms IS NULL OR event_us // 1000 + 1 > mark_ms GROUP BY batch
        UNION ALL SELECT batch, 'sources', count(*) FROM held
        WHERE status = 'applied' AND (mark_ms IS NULL OR event_us // 1000 + 1 > mark_ms) GROUP BY batch
        UNION ALL {_days('customer days', 'customer_id')} UNION ALL {_days('terminal days', 'terminal_id')}) x""",
    ("history", "deliveries"),
    _WIDE,
)
def state7_kept(spark, folder):
    """STATE-6, STATE-7: what the state keeps after each batch of a history of sixty days; timers remove the rest.

    The sixth batch has no rows: it is run because the watermark moved."""
    path = scratch(spark, "wide")
    start = load(spark, folder, "history").agg(F.min("event_us")).first()[0]
    rows = load(spark, folder, "deliveries")
    rows = rows.withColumns({c: F.col(c) * 2 - lit(start) for c in ("event_us", "received_us")})
    # Repeats and conflicts follow their first delivery, so that the span of each batch is as the SQL cuts it.
    partitions, groups = _layout(rows)
    keyed.run_keyed(keyed.keyed_features(_stream(spark, rows, path, 5, 12 * DAY), groups=groups), path, partitions)
    return keyed.kept(spark, path, 6)


@query(
    "pit7_hand_over",
    f"SELECT {_SHOWN} FROM f JOIN statuses ON statuses.seq = f.seq WHERE f.decision_us >= {_DAY0} + 20 * {DAY_US}",
    ("history", "deliveries"),
    {**_STATUS, "f": feature_sql("statuses", applied="status = 'applied'")},
)
def pit7_hand_over(spark, folder):
    """PIT-7, STR-2: history up to a cutoff becomes the state of a stream that starts there, as if it had read it."""
    path = scratch(spark, "handed")
    cutoff = first_day(load(spark, folder, "history")) + lit(20 * DAY)
    deliveries = load(spark, folder, "deliveries")
    before = deliveries.filter(F.col("received_us") < cutoff)
    applied = ap.apply_events(before).filter(F.col("status") == ap.APPLIED).checkpoint()
    stream = _stream(spark, deliveries.filter(F.col("received_us") >= cutoff), path, 1, 0)
    partitions, groups = _layout(deliveries)
    keyed.run_keyed(keyed.keyed_features(stream, applied=applied, groups=groups), path, partitions)
    return spark.read.parquet(f"{path}/out").select("seq", "status", "decision_us", *FEATURES, "history_complete")
