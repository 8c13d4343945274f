"""Queries over point-in-time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import DAY_US, query, r9
from tidegate.fixtures import load
from tidegate.functions.times import DAY, US, lit
from tidegate.operators import apply as ap
from tidegate.operators import compare
from tidegate.operators.features import FEATURES, available_at, changes, point_in_time
from tidegate.operators.splits import first_day, split_at_cutoff
from tidegate.plans.visibility import Scan, oversized, visible
from tidegate.session import scratch
from tidegate.sources.buckets import write_bucketed


def feature_sql(table: str = "history", available: str = "e.received_us", applied: str = "TRUE", complete: bool = False) -> str:
    """All features by joining every decision with its visible history."""
    d, h = DAY_US, 3_600_000_000
    cust = "e.customer_id = d.customer_id"
    term = "e.terminal_id = d.terminal_id"

    def count(who: str, width: int) -> str:
        return f"count(e.seq) FILTER (WHERE {who} AND e.event_us >= d.event_us - {width})"

    def mean(width: int) -> str:
        total = f"sum(e.amount_minor) FILTER (WHERE {cust} AND e.event_us >= d.event_us - {width})"
        return f"CAST({total} AS DOUBLE) / CAST({count(cust, width)} AS DOUBLE)"

    return f"""
        SELECT d.seq, d.event_id, d.customer_id, d.terminal_id, d.event_us, d.received_us,
               d.received_us AS decision_us, d.amount_minor,
               (d.event_us // {h}) % 24 AS hour_of_day_utc, (d.event_us // {d} + 3) % 7 AS day_of_week_utc,
               {count(cust, h)} AS cust_txn_count_1h, {count(cust, d)} AS cust_txn_count_1d,
               {count(cust, 7 * d)} AS cust_txn_count_7d, {count(cust, 30 * d)} AS cust_txn_count_30d,
               CASE WHEN {count(cust, 7 * d)} > 0 THEN {mean(7 * d)} END AS cust_amount_mean_7d,
               CASE WHEN {count(cust, 30 * d)} > 0 THEN {mean(30 * d)} END AS cust_amount_mean_30d,
               CASE WHEN {count(cust, 30 * d)} > 0 AND {mean(30 * d)} > 0
                    THEN CAST(d.amount_minor AS DOUBLE) / ({mean(30 * d)}) END AS amount_to_cust_mean_30d,
               CAST(d.event_us - max(e.event_us) FILTER (WHERE {cust}) AS DOUBLE) / CAST(1000000 AS DOUBLE)
                    AS secs_since_prev_cust_txn,
               CAST(CASE WHEN {count(cust, 30 * d)} > 0 THEN 1 ELSE 0 END AS BIGINT) AS cust_has_history_30d,
               CAST(CASE WHEN count(e.seq) FILTER (WHERE {cust} AND {term}) > 0 THEN 0 ELSE 1 END AS BIGINT)
                    AS cust_terminal_is_new_30d,
               {count(term, d)} AS term_txn_count_1d, {count(term, 7 * d)} AS term_txn_count_7d
        FROM {table} d LEFT JOIN {table} e
          ON e.event_us < d.event_us AND e.event_us >= d.event_us - 30 * CAST({d} AS BIGINT)
             AND {available} <= d.received_us AND e.event_id <> d.event_id AND {applied.replace('status', 'e.status') if applied != 'TRUE' else 'TRUE'}
             AND ({cust} OR {term})
        GROUP BY d.seq, d.event_id, d.customer_id, d.terminal_id, d.event_us, d.received_us, d.amount_minor"""


def events(spark, folder):
    """The columns that features need; the payload hash stays behind."""
    columns = ["seq", "event_id", "customer_id", "terminal_id", "amount_minor", "event_us", "received_us"]
    return load(spark, folder, "history").select(*columns)


LEAKY = "e.event_us"
_NAMES = ", ".join(FEATURES)
_SHOWN = ["seq", "decision_us", *FEATURES, "history_complete"]


@query(
    "pit1_point_in_time_features",
    f"SELECT seq, decision_us, {_NAMES}, TRUE AS history_complete FROM f",
    ("history",),
    {"f": feature_sql()},
)
def pit1(spark, folder):
    """PIT-1, JOIN-2, WIN-1, FEAT-1..17: every decision with the history it could see."""
    return point_in_time(events(spark, folder)).select(*_SHOWN)


_STATUS = {
    # The tables span less than the horizon, so the first arrival of an id or a source decides.
    "placed": """SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_us, seq) AS nth,
                        first_value(payload_hash) OVER (PARTITION BY event_id ORDER BY received_us, seq) AS p0,
                        first_value(source_id) OVER (PARTITION BY event_id ORDER BY received_us, seq) AS s0,
                        first_value(event_id) OVER (PARTITION BY source_id ORDER BY received_us, seq) AS e0
                 FROM deliveries""",
    "statuses": """SELECT *, CASE WHEN nth = 1 AND e0 = event_id THEN 'applied'
                                  WHEN nth = 1 THEN 'event_id_conflict'
                                  WHEN p0 <> payload_hash THEN 'payload_conflict'
                                  WHEN s0 <> source_id THEN 'event_id_conflict'
                                  ELSE 'duplicate' END AS status FROM placed""",
}


@query(
    "pit1_features_of_deliveries",
    f"SELECT seq, decision_us, {_NAMES}, TRUE AS history_complete FROM f",
    ("deliveries",),
    {**_STATUS, "f": feature_sql("statuses", applied="status = 'applied'")},
)
def pit1_deliveries(spark, folder):
    """PIT-1 on a stream with redeliveries and conflicts: each delivery is decided, applied ones are history."""
    applied = ap.apply_events(load(spark, folder, "deliveries")).checkpoint()
    return point_in_time(applied, repeated_ids=True).select(*_SHOWN)


@query(
    "pit2_leaky_features",
    f"SELECT seq, decision_us, {_NAMES}, TRUE AS history_complete FROM f",
    ("history",),
    {"f": feature_sql(available=LEAKY)},
)
def pit2(spark, folder):
    """PIT-2: the shortcut that ignores arrival, to measure what it leaks."""
    return point_in_time(events(spark, folder), availability="event_time").select(*_SHOWN)


def _both(spark, folder, **other):
    history = events(spark, folder)
    left = point_in_time(history).select("seq", "decision_us", *FEATURES)
    right = point_in_time(history, **other).select("seq", *FEATURES)
    return left, right


_CHANGED = " OR ".join(f"a.{f} IS DISTINCT FROM b.{f}" for f in FEATURES)


@query(
    "pit3_leak_report",
    f"""SELECT count(*) AS decisions, count(*) FILTER (WHERE {_CHANGED}) AS changed,
               round(CAST(count(*) FILTER (WHERE {_CHANGED}) AS DOUBLE) / count(*), 9) AS rate
        FROM f a JOIN g b ON a.seq = b.seq""",
    ("history",),
    {"f": feature_sql(), "g": feature_sql(available=LEAKY)},
)
def pit3(spark, folder):
    """PIT-3: decisions whose vector changes when arrival is ignored."""
    found = changes(events(spark, folder), {"all": lit(2**62)})
    changed = F.count_if("changed")
    return found.agg(
        F.count(F.lit(1)).alias("decisions"), changed.alias("changed"), r9(changed.cast("double") / F.count(F.lit(1)), "rate")
    )


@query(
    "pit4_delay_sensitivity",
    " UNION ALL ".join(
        f"""SELECT CAST({s} AS BIGINT) AS delay_seconds, count(*) AS decisions, count(*) FILTER (WHERE {_CHANGED}) AS changed
            FROM f a JOIN g{s} b ON a.seq = b.seq"""
        for s in (1, 60)
    ),
    ("history",),
    {"f": feature_sql(), **{f"g{s}": feature_sql(available=f"e.received_us + {s * US}") for s in (1, 60)}},
)
def pit4(spark, folder):
    """PIT-4: decisions that change when events become visible 1 s and 60 s after they arrive."""
    found = changes(events(spark, folder), {str(s): F.col("received_us") - lit(s * US) for s in (1, 60)})
    return found.groupBy(F.col("variant").cast("bigint").alias("delay_seconds")).agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if("changed").alias("changed")
    )


_DAY0 = f"(SELECT min(event_us) - min(event_us) % {DAY_US} FROM history)"


@query(
    "pit5_split_at_cutoff",
    f"""SELECT count(*) FILTER (WHERE received_us < {_DAY0} + 20 * {DAY_US}) AS bootstrap,
               count(*) FILTER (WHERE received_us >= {_DAY0} + 20 * {DAY_US}) AS scoring, count(*) AS total
        FROM history""",
    ("history",),
)
def pit5(spark, folder):
    """PIT-5: history to load before a cutoff, and decisions to make from it on."""
    history = load(spark, folder, "history")
    split = split_at_cutoff(history, first_day(history) + lit(20 * DAY))
    return split.agg(
        F.count_if("bootstrap").alias("bootstrap"), F.count_if("scoring").alias("scoring"), F.count(F.lit(1)).alias("total")
    )


@query(
    "pit6_straddlers",
    f"""SELECT seq, event_us, received_us FROM history
        WHERE event_us < {_DAY0} + 27 * {DAY_US} AND received_us >= {_DAY0} + 27 * {DAY_US}""",
    ("history",),
)
def pit6(spark, folder):
    """PIT-6: events before the cutoff that were decided after it."""
    history = load(spark, folder, "history")
    cutoff = first_day(history) + lit(27 * DAY)
    split = split_at_cutoff(history, cutoff).filter("scoring").filter(F.col("event_us") < cutoff)
    return split.select("seq", "event_us", "received_us")


@query(
    "pit7_bootstrap_state",
    f"""SELECT customer_id, count(*) AS applied_count, max(received_us) AS last_applied_us,
               arg_max(event_id, (received_us, seq)) AS last_event_id
        FROM statuses WHERE status = 'applied' AND received_us < {_DAY0} + 20 * {DAY_US}
          AND received_us >= {_DAY0} + 5 * {DAY_US}
        GROUP BY customer_id""",
    ("deliveries",),
    {
        **_STATUS,
    },
)
def pit7(spark, folder):
    """PIT-7: state loaded from the history available in [start, cutoff), in arrival order."""
    deliveries = load(spark, folder, "deliveries")
    day0 = first_day(load(spark, folder, "history"))
    start, cutoff = day0 + lit(5 * DAY), day0 + lit(20 * DAY)
    window = deliveries.filter((F.col("received_us") >= start) & (F.col("received_us") < cutoff))
    return ap.entity_metadata(ap.apply_events(window), "customer_id")


@query(
    "pit8_late_examples",
    """SELECT d.seq, count(e.seq) AS later_arrivals
       FROM history d JOIN history e ON e.customer_id = d.customer_id
         AND e.event_us < d.event_us AND e.received_us > d.received_us
       GROUP BY d.seq""",
    ("history",),
)
def pit8(spark, folder):
    """PIT-8: how many earlier events of the customer arrived only after each decision."""
    history = events(spark, folder).withColumn("decision_us", F.col("received_us"))
    rows = history.count()
    scan = Scan("c", ("customer_id",), (("now", 0),))
    args = dict(event_us="event_us", decision_us="decision_us", weight="amount_minor", is_point=F.lit(True),
                row_id="seq", rows=rows, hot=oversized(history, scan.keys, rows, 500_000))
    seen = visible(history, [scan], available_us=available_at(), **args).withColumnRenamed("c_n_now", "seen")
    # The same count when everything is available at once.
    happened = visible(seen, [scan], available_us=lit(0), **args)
    return happened.select("seq", (F.col("c_n_now") - F.col("seen")).alias("later_arrivals")).filter("later_arrivals > 0")


_PER_FEATURE = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (WHERE a.{f} IS DISTINCT FROM b.{f}) AS different FROM f a JOIN g b ON a.seq = b.seq"
    for f in FEATURES
)


@query(
    "join10_parity_by_feature",
    _PER_FEATURE,
    ("history",),
    {"f": feature_sql(), "g": feature_sql(available=f"e.received_us + {60 * US}")},
)
def join10(spark, folder):
    """JOIN-10, PIT-9: stored against expected vectors, differences per feature."""
    left, right = _both(spark, folder, delay_us=60 * US)
    return compare.differences_by_column(compare.aligned(left, right, "seq", FEATURES), FEATURES, "feature")


@query(
    "join10_parity_by_feature_bucketed",
    _PER_FEATURE,
    ("history",),
    {"f": feature_sql(), "g": feature_sql(available=f"e.received_us + {60 * US}")},
)
def join10_bucketed(spark, folder):
    """JOIN-10 over two stored tables of vectors that share their buckets: the join moves no rows."""
    left, right = (write_bucketed(df, scratch(spark, "vectors"), "seq", 8) for df in _both(spark, folder, delay_us=60 * US))
    both = compare.aligned(left.hint("merge"), right, "seq", FEATURES)
    return compare.differences_by_column(both, FEATURES, "feature")


_STORED_SCORE = "CASE WHEN secs_since_prev_cust_txn IS NULL THEN CAST(0.5 AS DOUBLE) ELSE CAST(cust_txn_count_7d + term_txn_count_1d AS DOUBLE) / CAST(cust_txn_count_7d + term_txn_count_1d + 20 AS DOUBLE) END"
_STORED_ACTION = f"CASE WHEN ({_STORED_SCORE}) >= CAST(0.5 AS DOUBLE) THEN 'review' ELSE 'approve' END"


def _audit(spark, folder):
    left, right = _both(spark, folder, delay_us=3600 * US)
    columns = ["seq", F.expr(_STORED_SCORE).alias("score"), F.expr(_STORED_ACTION).alias("action")]
    return left.select(*columns), right.select(*columns)


@query(
    "agg14_score_changes",
    f"""SELECT count(*) AS decisions, count(*) FILTER (WHERE d > 0) AS changed, round(max(d), 9) AS largest,
               round(coalesce(quantile_cont(d, 0.5) FILTER (WHERE d > 0), 0), 9) AS median_change
        FROM (SELECT abs(a.s - b.s) AS d FROM (SELECT seq, {_STORED_SCORE} AS s FROM f) a
              JOIN (SELECT seq, {_STORED_SCORE} AS s FROM g) b ON a.seq = b.seq) x""",
    ("history",),
    {"f": feature_sql(), "g": feature_sql(available=f"e.received_us + {3600 * US}")},
)
def agg14(spark, folder):
    """AGG-14: how many scores change between two vectors, and by how much."""
    left, right = _audit(spark, folder)
    out = compare.score_changes(left, right, "seq")
    return out.select("decisions", "changed", r9("largest"), r9("median_change"))


@query(
    "agg15_action_transitions",
    f"""SELECT a.x AS expected, b.x AS actual, count(*) AS n FROM (SELECT seq, {_STORED_ACTION} AS x FROM f) a
        JOIN (SELECT seq, {_STORED_ACTION} AS x FROM g) b ON a.seq = b.seq GROUP BY 1, 2""",
    ("history",),
    {"f": feature_sql(), "g": feature_sql(available=f"e.received_us + {3600 * US}")},
)
def agg15(spark, folder):
    """AGG-15: expected action against the action that was taken."""
    left, right = _audit(spark, folder)
    return compare.transitions(left, right, "seq", "action")


@query(
    "agg19_repeat_entities",
    """SELECT count(*) FILTER (WHERE n > 1) AS repeated, max(n) AS most FROM
       (SELECT customer_id, count(*) AS n FROM history GROUP BY customer_id) x""",
    ("history",),
)
def agg19(spark, folder):
    """AGG-19: customers seen more than once, and the most rows of one customer."""
    counts = load(spark, folder, "history").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("most"))


@query(
    "agg20_repeat_trace",
    """SELECT a.customer_id, a.seq, a.decision_us, a.cust_txn_count_1d AS expected_count_1d, b.cust_txn_count_1d AS stored_count_1d
       FROM f a JOIN g b ON a.seq = b.seq
       WHERE a.customer_id IN (SELECT customer_id FROM history GROUP BY customer_id HAVING count(*) > 1)""",
    ("history",),
    {"f": feature_sql(), "g": feature_sql(available=f"e.received_us + {60 * US}")},
)
def agg20(spark, folder):
    """AGG-20: decisions of customers seen more than once, as rows; a trace is their decision order."""
    history = events(spark, folder)
    left = point_in_time(history).select("customer_id", "seq", "decision_us", F.col("cust_txn_count_1d").alias("expected_count_1d"))
    right = point_in_time(history, delay_us=60 * US).select("seq", F.col("cust_txn_count_1d").alias("stored_count_1d"))
    repeated = history.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return left.join(right, "seq").join(repeated, "customer_id", "left_semi").select(
        "customer_id", "seq", "decision_us", "expected_count_1d", "stored_count_1d"
    )


@query(
    "join7_previous_event",
    """SELECT d.seq, max(e.event_us) AS previous_us FROM history d LEFT JOIN history e
         ON e.customer_id = d.customer_id AND e.event_us < d.event_us AND e.received_us <= d.received_us
       GROUP BY d.seq""",
    ("history",),
)
def join7(spark, folder):
    """JOIN-7: the newest earlier event of the customer that the decision could see."""
    history = events(spark, folder)
    rows = history.count()
    scan = Scan("c", ("customer_id",), (("now", 0),), last=("now",))
    seen = visible(
        history, [scan], event_us="event_us", available_us=available_at(), decision_us="received_us",
        weight="amount_minor", is_point=F.lit(True), row_id="seq", rows=rows,
        hot=oversized(history, scan.keys, rows, 500_000),
    )
    return seen.select("seq", F.col("c_last_now").alias("previous_us"))


@query("prj1_available_at", "SELECT seq, received_us + 1000000 AS available_us, event_us AS leaky_us FROM history", ("history",))
def prj1(spark, folder):
    """PRJ-1: when an event becomes history, with a processing delay and with the shortcut."""
    history = load(spark, folder, "history")
    return history.select("seq", available_at(US).alias("available_us"), available_at(0, "event_time").alias("leaky_us"))
