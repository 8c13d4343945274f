"""Queries over delivery statuses and the state they build."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import DAY_US, query
from tidegate.catalog.pit import _STATUS
from tidegate.fixtures import load
from tidegate.functions.times import lit
from tidegate.operators import apply as ap
from tidegate.plans.ordered import chunked, row_numbers, running


@query("state1_apply_statuses", "SELECT seq, status FROM statuses", ("deliveries",), _STATUS)
def state1(spark, folder):
    """STATE-1, STATE-2, STATE-3: one status per delivery."""
    return ap.apply_events(load(spark, folder, "deliveries")).select("seq", "status")


_LATE = {
    "marked": """SELECT *, max(event_us) OVER (ORDER BY received_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                           - CAST(2678400000000 AS BIGINT) AS horizon FROM late_deliveries""",
    "timely": "SELECT * FROM marked WHERE horizon IS NULL OR event_us >= horizon",
    "placed": """SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_us, seq) AS nth,
                        first_value(payload_hash) OVER (PARTITION BY event_id ORDER BY received_us, seq) AS p0,
                        first_value(source_id) OVER (PARTITION BY event_id ORDER BY received_us, seq) AS s0,
                        first_value(event_id) OVER (PARTITION BY source_id ORDER BY received_us, seq) AS e0
                 FROM timely""",
    "statuses": """SELECT seq, event_us, received_us, event_id, CASE WHEN nth = 1 AND e0 = event_id THEN 'applied'
                                  WHEN nth = 1 THEN 'event_id_conflict'
                                  WHEN p0 <> payload_hash THEN 'payload_conflict'
                                  WHEN s0 <> source_id THEN 'event_id_conflict'
                                  ELSE 'duplicate' END AS status FROM placed
                   UNION ALL SELECT seq, event_us, received_us, event_id, 'late_beyond_horizon' FROM marked
                   WHERE horizon IS NOT NULL AND event_us < horizon""",
}


@query("state4_late_rejection", "SELECT seq, status FROM statuses", ("late_deliveries",), _LATE)
def state4(spark, folder):
    """STATE-4: events older than the horizon are late, before any identity is looked at."""
    return ap.apply_events(load(spark, folder, "late_deliveries")).select("seq", "status")


@query("agg6_apply_status_counts", "SELECT status, count(*) AS n FROM statuses GROUP BY status", ("late_deliveries",), _LATE)
def agg6(spark, folder):
    """AGG-6: deliveries per status."""
    return ap.status_counts(ap.apply_events(load(spark, folder, "late_deliveries")))


@query(
    "agg7_entity_metadata",
    """SELECT terminal_id, count(*) AS applied_count, max(received_us) AS last_applied_us,
              arg_max(event_id, (received_us, seq)) AS last_event_id
       FROM statuses WHERE status = 'applied' GROUP BY terminal_id""",
    ("deliveries",),
    _STATUS,
)
def agg7(spark, folder):
    """AGG-7: applied events per terminal and the newest of them."""
    return ap.entity_metadata(ap.apply_events(load(spark, folder, "deliveries")), "terminal_id")


@query(
    "win7_first_by_arrival",
    "SELECT event_id, seq, received_us FROM placed WHERE nth = 1",
    ("deliveries",),
    _STATUS,
)
def win7(spark, folder):
    """WIN-7, STATE-2: the first delivery of each id; an aggregate, so a hot id is combined early."""
    first = F.min(F.struct("received_us", "seq")).alias("f")
    return load(spark, folder, "deliveries").groupBy("event_id").agg(first).select("event_id", "f.seq", "f.received_us")


@query(
    "state3_source_owner",
    """SELECT source_id, arg_min(event_id, (received_us, seq)) AS owner, count(DISTINCT event_id) AS claimed_by
       FROM deliveries GROUP BY source_id HAVING count(DISTINCT event_id) > 1""",
    ("deliveries",),
)
def state3(spark, folder):
    """STATE-3, JOIN-12: sources claimed by several transactions and the one that owns them."""
    claims = load(spark, folder, "deliveries").groupBy("source_id", "event_id").agg(F.min(F.struct("received_us", "seq")).alias("at"))
    owners = claims.groupBy("source_id").agg(F.min_by("event_id", "at").alias("owner"), F.count(F.lit(1)).alias("claimed_by"))
    return owners.filter("claimed_by > 1")


@query(
    "state5_running_watermark",
    "SELECT seq, max(event_us) OVER (ORDER BY received_us, seq ROWS UNBOUNDED PRECEDING) AS watermark_us FROM history",
    ("history",),
)
def state5(spark, folder):
    """STATE-5, WIN-6: the newest event time so far, in arrival order, without a one-task window."""
    history = load(spark, folder, "history")
    order = [F.col("received_us"), F.col("seq")]
    chunks = chunked(history, order)
    return running(chunks, order, {"watermark_us": ("max", F.col("event_us"))}).select("seq", "watermark_us")


_AS_OF = 1706400000000000  # a fixed instant inside the month of the tables


@query(
    "state6_retained_history",
    f"""SELECT seq, event_us FROM statuses WHERE status = 'applied' AND received_us <= {_AS_OF}
        AND event_us >= (SELECT max(event_us) FROM statuses WHERE status = 'applied' AND received_us <= {_AS_OF}) - 31 * {DAY_US}""",
    ("late_deliveries",),
    _LATE,
)
def state6(spark, folder):
    """STATE-6: the history that the horizon keeps at an instant."""
    applied = ap.apply_events(load(spark, folder, "late_deliveries")).checkpoint()
    return ap.retained(applied, _AS_OF).select("seq", "event_us")


@query(
    "state7_live_identities",
    f"""SELECT event_id, event_us FROM statuses WHERE status = 'applied' AND received_us <= {_AS_OF}
        AND event_us >= (SELECT max(event_us) FROM statuses WHERE status = 'applied' AND received_us <= {_AS_OF}) - 31 * {DAY_US}""",
    ("late_deliveries",),
    _LATE,
)
def state7(spark, folder):
    """STATE-7: identity records that still block repeats at an instant."""
    applied = ap.apply_events(load(spark, folder, "late_deliveries")).checkpoint()
    return ap.live_identities(applied, _AS_OF).select("event_id", "event_us")


@query(
    "state8_entity_snapshot",
    f"""SELECT customer_id, count(*) AS applied_count, max(received_us) AS last_applied_us, sum(amount_minor)::BIGINT AS amount_minor
        FROM statuses WHERE status = 'applied' AND received_us <= {_AS_OF} GROUP BY customer_id""",
    ("deliveries",),
    _STATUS,
)
def state8(spark, folder):
    """STATE-8: the state of every customer at an instant."""
    applied = ap.apply_events(load(spark, folder, "deliveries"))
    return applied.filter((F.col("status") == ap.APPLIED) & (F.col("received_us") <= lit(_AS_OF))).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("applied_count"),
        F.max("received_us").alias("last_applied_us"),
        F.sum("amount_minor").alias("amount_minor"),
    )


@query(
    "sort1_canonical_order",
    "SELECT seq, row_number() OVER (ORDER BY event_us, seq) AS place FROM history",
    ("history",),
)
def sort1(spark, folder):
    """SORT-1: the place of each event in the canonical order."""
    history = load(spark, folder, "history")
    return row_numbers(history, [F.col("event_us"), F.col("seq")], name="place").select("seq", "place")
