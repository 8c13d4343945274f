"""Queries over decisions, outbox, reviews, jobs and scrapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import query, rounded
from tidegate.fixtures import DECLINE_AT, REVIEW_AT, load, source
from tidegate.functions.times import US, lit
from tidegate.operators import decide, operations as ops, telemetry
from tidegate.plans.ordered import row_numbers

NOW = 1706572800000000  # 2024-01-30 00:00 UTC, inside the month of the tables
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
_NS = "EXISTS (SELECT 1 FROM outbox o WHERE o.aggregate_id = d.transaction_id AND o.event_type = 'decision.made' AND o.stream = 'live')"
_CODES = "['" + "','".join(decide.DEGRADED_CODES) + "']"
_DEGRADED = f"(d.score IS NULL OR list_has_any(d.reason_codes, {_CODES}))"
_LATEST = """SELECT transaction_id, arg_max(status, id) AS status, arg_max(coalesce(disposition, ''), id) AS disposition,
                    arg_max(analyst, id) AS analyst, max(id) AS id, arg_max(created_us, id) AS created_us FROM reviews GROUP BY transaction_id"""


def _live(spark, folder):
    return ops.in_namespace(load(spark, folder, "decisions"), load(spark, folder, "outbox"), "live")


def _activity_sql(span: int, step: int) -> str:
    return f"""SELECT decision_us - (decision_us - 946684800000000) % {step} AS bucket_us, count(*) AS total,
        count(*) FILTER (WHERE action = 'approve') AS approve, count(*) FILTER (WHERE action = 'review') AS review,
        count(*) FILTER (WHERE action = 'decline') AS decline, count(*) FILTER (WHERE score IS NULL) AS scoreless,
        count(*) FILTER (WHERE {_DEGRADED}) AS degraded
        FROM decisions d WHERE decision_us >= {NOW - span} AND {_NS} GROUP BY 1"""


for _key, (_span, _step) in ops.RANGES.items():

    @query(f"agg1_activity_{_key}", _activity_sql(_span, _step), ("decisions", "outbox"))
    def agg1(spark, folder, key=_key):
        """AGG-1: decisions per bucket of a range, by action and state."""
        return ops.activity(ops.since(_live(spark, folder), key, NOW), ops.RANGES[key][1])


@query(
    "agg1_activity_totals",
    "SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("total", "approve", "review", "decline", "scoreless", "degraded")) + " FROM a",
    ("decisions", "outbox"),
    {"a": _activity_sql(DAY_US, 900 * US)},
)
def agg1_totals(spark, folder):
    """AGG-1: the totals of the buckets of a day."""
    return ops.activity_totals(ops.activity(ops.since(_live(spark, folder), "24h", NOW), ops.RANGES["24h"][1]))


@query(
    "agg2_review_status_counts",
    f"""SELECT s.status, count(q.status) AS n FROM (VALUES ('open'), ('in_review'), ('closed')) s(status)
        LEFT JOIN (SELECT coalesce(l.status, 'open') AS status FROM decisions d LEFT JOIN latest l ON l.transaction_id = d.transaction_id
                   WHERE d.action = 'review' AND {_NS}) q ON q.status = s.status GROUP BY s.status""",
    ("decisions", "outbox", "reviews"),
    {"latest": _LATEST},
)
def agg2(spark, folder):
    """AGG-2: cases per review status, zero where there is none."""
    return ops.status_counts(ops.review_queue(_live(spark, folder), load(spark, folder, "reviews")))


@query(
    "agg3_identity_counts",
    "SELECT model_version, policy_version, model_registry_ref, count(*) AS n FROM decisions d GROUP BY 1, 2, 3",
    ("decisions",),
)
def agg3(spark, folder):
    """AGG-3: decisions per model, policy and registry reference."""
    return ops.identities(load(spark, folder, "decisions"))


@query(
    "agg4_identity_consistency",
    """SELECT bool_and(ok) AS consistent, count(*) FILTER (WHERE NOT ok) AS different FROM (
       SELECT model_version IS NOT DISTINCT FROM 'model-1' AND policy_version IS NOT DISTINCT FROM 'pol-1'
              AND model_registry_ref IS NOT DISTINCT FROM 'scorer/2' AS ok FROM decisions) t""",
    ("decisions",),
)
def agg4(spark, folder):
    """AGG-4: whether every decision was made by the target identity."""
    return ops.matches_identity(load(spark, folder, "decisions"), "model-1", "pol-1", "scorer/2")


@query(
    "agg8_backlog",
    f"""SELECT count(*) AS waiting, min(created_us) AS oldest_us, CAST({NOW} - min(created_us) AS DOUBLE) / 1000000 AS age_s
        FROM outbox WHERE published_us IS NULL AND stream = 'live'""",
    ("outbox",),
)
def agg8(spark, folder):
    """AGG-8: unpublished rows of a stream and the age of the oldest."""
    return ops.backlog(load(spark, folder, "outbox"), NOW, "live")


@query(
    "agg9_latency_percentiles",
    """SELECT stream, count(*) AS rows, round(quantile_cont(ms, 0.5), 9) AS p50, round(quantile_cont(ms, 0.95), 9) AS p95,
              round(quantile_cont(ms, 0.99), 9) AS p99, max(ms) AS max_ms, round(avg(ms), 9) AS mean_ms
       FROM (SELECT stream, CAST(published_us - created_us AS DOUBLE) / 1000 AS ms FROM outbox WHERE published_us IS NOT NULL) t GROUP BY stream""",
    ("outbox",),
)
def agg9(spark, folder):
    """AGG-9: exact publish delays per stream."""
    return rounded(ops.delays(load(spark, folder, "outbox"), "created_us", "published_us", ["stream"]), "p50", "p95", "p99", "mean_ms")


_PAIRS = {
    "times": "SELECT DISTINCT scrape_us FROM scrapes",
    "pairs": f"""SELECT a.scrape_us, min(b.scrape_us) AS old_us FROM times a JOIN times b
                 ON b.scrape_us < a.scrape_us AND b.scrape_us >= a.scrape_us - {6 * HOUR_US} GROUP BY a.scrape_us""",
    "deltas": """SELECT s.scrape_us, p.old_us, s.sample, s.value - coalesce(o.value, 0) AS delta,
                        CAST(s.scrape_us - p.old_us AS DOUBLE) / 1000000 AS seconds
                 FROM scrapes s JOIN pairs p ON s.scrape_us = p.scrape_us
                 LEFT JOIN scrapes o ON o.scrape_us = p.old_us AND o.sample = s.sample""",
    "cells": """SELECT scrape_us, CASE WHEN le = '+Inf' THEN 'infinity'::DOUBLE ELSE le::DOUBLE END AS le, delta FROM (
                SELECT scrape_us, regexp_extract(sample, 'le="([^"]*)"', 1) AS le, delta FROM deltas WHERE sample LIKE 'request_seconds_bucket%') t""",
}


def _deltas(spark, folder):
    return telemetry.deltas(load(spark, folder, "scrapes"), 6 * HOUR_US)


@query(
    "win9_scrape_pairs",
    "SELECT scrape_us, old_us, sample, delta FROM deltas",
    ("scrapes",),
    _PAIRS,
)
def win9(spark, folder):
    """WIN-9: each scrape against the oldest one inside the window."""
    return _deltas(spark, folder).select("scrape_us", "old_us", "sample", "delta")


@query(
    "agg11_request_rates",
    """SELECT scrape_us, CAST(sum(delta) AS BIGINT) AS requests, round(sum(delta) / max(seconds), 2) AS per_second,
              CAST(coalesce(sum(delta) FILTER (WHERE sample NOT LIKE '%status="2%'), 0) AS BIGINT) AS errors,
              CASE WHEN sum(delta) > 0 THEN round(coalesce(sum(delta) FILTER (WHERE sample NOT LIKE '%status="2%'), 0) / sum(delta), 4) END AS error_rate
       FROM deltas WHERE sample LIKE 'responses_total%' GROUP BY scrape_us HAVING min(delta) >= 0 AND sum(delta) >= 0""",
    ("scrapes",),
    _PAIRS,
)
def agg11(spark, folder):
    """AGG-11: rates between scrapes; pairs that span a restart are left out."""
    return telemetry.rates(_deltas(spark, folder), "responses_total")


@query(
    "agg10_histogram_quantile",
    """SELECT scrape_us, CASE WHEN min(le) < 'infinity'::DOUBLE THEN min(le) END AS bound FROM (
         SELECT c.scrape_us, c.le FROM cells c JOIN (SELECT scrape_us, max(delta) AS total FROM cells GROUP BY scrape_us) t ON t.scrape_us = c.scrape_us
         WHERE t.total > 0 AND c.delta >= CAST(0.95 AS DOUBLE) * t.total) x GROUP BY scrape_us""",
    ("scrapes",),
    _PAIRS,
)
def agg10(spark, folder):
    """AGG-10: the bucket bound that holds 95% of the requests."""
    cells = telemetry.bucket_cells(_deltas(spark, folder), "request_seconds_bucket", ["scrape_us"], stage="request_total")
    return telemetry.histogram_bound(cells, 0.95, ["scrape_us"])


_JOB_OUTCOME = """CASE WHEN status = 200 THEN 'idempotent_replay' WHEN status = 201 AND score IS NULL THEN 'scoreless_review'
                       WHEN status = 201 THEN action ELSE concat('http_', status::VARCHAR) END"""


@query("agg12_job_outcomes", f"SELECT {_JOB_OUTCOME} AS outcome, count(*) AS n FROM jobs GROUP BY 1", ("jobs",))
def agg12(spark, folder):
    """AGG-12: demo requests per outcome."""
    jobs = load(spark, folder, "jobs")
    outcome = ops.job_outcome(F.col("status"), F.col("score"), F.col("action"))
    return jobs.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg12_response_outcomes",
    """SELECT CASE WHEN txn_id % 59 = 0 THEN 'backlog_rejected' WHEN txn_id % 43 = 0 THEN 'http_422'
                   WHEN score IS NULL OR list_contains(reason_codes, 'FEATURES_UNAVAILABLE') THEN 'degraded_review_no_score'
                   WHEN list_contains(reason_codes, 'PIPELINE_DEGRADED') THEN 'model_scored_pipeline_degraded' ELSE 'model_scored' END AS outcome,
              count(*) AS n FROM decisions GROUP BY 1""",
    ("decisions",),
)
def agg12_responses(spark, folder):
    """AGG-12: responses as served, degraded, refused or failed."""
    rows = load(spark, folder, "decisions")
    refused, failed = F.col("txn_id") % 59 == 0, F.col("txn_id") % 43 == 0
    status = F.when(refused, 503).when(failed, 422).otherwise(201)
    error = F.when(refused, F.lit("pipeline_backlog_limit"))
    outcome = ops.outcome(status, F.col("score"), F.col("reason_codes"), error)
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_PASS = "p95 <= 100 AND p99 <= 200 AND rps >= 99 AND failed / scheduled <= 0.001"


@query("agg13_criterion_tally", f"SELECT model, stats_on, count(*) FILTER (WHERE {_PASS}) AS passed, count(*) AS runs FROM runs GROUP BY 1, 2", ("runs",))
def agg13(spark, folder):
    """AGG-13: load runs that pass the serving criterion, per model and flag."""
    ok = ops.passes(*[F.col(c) for c in ("p95", "p99", "rps", "failed", "scheduled")])
    return load(spark, folder, "runs").groupBy("model", "stats_on").agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("runs"))


@query("agg16_next_offset", "SELECT namespace, coalesce(max(start_offset + sent), 0) AS next_offset FROM jobs GROUP BY namespace", ("jobs",))
def agg16(spark, folder):
    """AGG-16: where the next job of a namespace starts."""
    return ops.next_offset(load(spark, folder, "jobs"))


@query("agg17_value_counts", "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1")
def agg17(spark, folder):
    """AGG-17: how often each value occurs."""
    return source(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg18_distinct_keys",
    "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(DISTINCT o_custkey) AS customers, count(*) = count(DISTINCT o_orderkey) AS unique_keys FROM orders",
)
def agg18(spark, folder):
    """AGG-18: distinct keys, and whether they are unique."""
    orders = source(spark, folder, "orders")
    n, keys = F.count(F.lit(1)), F.count_distinct("o_orderkey")
    return orders.agg(n.alias("rows"), keys.alias("keys"), F.count_distinct("o_custkey").alias("customers")).withColumn(
        "unique_keys", F.col("rows") == F.col("keys")
    )


@query(
    "agg18_merged_sketches",
    "SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT o_custkey) AS customers, TRUE AS close FROM orders GROUP BY 1",
)
def agg18_sketches(spark, folder):
    """AGG-18: distinct customers of a year from the sketches of its days, within 4% of the exact number."""
    orders = source(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    days = ops.distinct_sketches(orders, ["year", "o_orderdate"], "o_custkey")
    exact = orders.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("customers"))
    close = F.abs(F.col("distinct_values") - F.col("customers")) <= 0.04 * F.col("customers")
    return exact.join(ops.merged_sketches(days, ["year"]), "year").select("year", "rows", "customers", close.alias("close"))


_LIST = "SELECT transaction_id, decision_us, amount_minor, score, action"


@query(
    "pred5_scoreless_reviews",
    f"{_LIST} FROM decisions d WHERE decision_us >= {NOW - DAY_US} AND action = 'review' AND score IS NULL",
    ("decisions",),
)
def pred5(spark, folder):
    """PRED-5: decisions of a range by action and scoring."""
    rows = ops.since(load(spark, folder, "decisions"), "24h", NOW)
    return ops.matching(rows, action="review", scored=False).select("transaction_id", "decision_us", "amount_minor", "score", "action")


@query("pred5_degraded", f"{_LIST} FROM decisions d WHERE {_DEGRADED}", ("decisions",))
def pred5_degraded(spark, folder):
    """PRED-5: decisions made in a degraded state."""
    return ops.matching(load(spark, folder, "decisions"), is_degraded=True).select("transaction_id", "decision_us", "amount_minor", "score", "action")


@query("pred5_not_degraded", f"SELECT action, count(*) AS n FROM decisions d WHERE NOT {_DEGRADED} GROUP BY action", ("decisions",))
def pred5_not(spark, folder):
    """PRED-5: the others, per action."""
    rows = ops.matching(load(spark, folder, "decisions"), is_degraded=False)
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("pred6_namespace", f"SELECT transaction_id FROM decisions d WHERE {_NS}", ("decisions", "outbox"))
def pred6(spark, folder):
    """PRED-6: decisions whose event belongs to a namespace."""
    return _live(spark, folder).select("transaction_id")


@query(
    "pred7_membership",
    "SELECT transaction_id, action FROM decisions WHERE transaction_id IN (SELECT transaction_id FROM reviews WHERE status = 'closed')",
    ("decisions", "reviews"),
)
def pred7(spark, folder):
    """PRED-7: decisions of a list of ids; Spark broadcasts the list only while it is small."""
    listed = load(spark, folder, "reviews").filter("status = 'closed'").select("transaction_id")
    return load(spark, folder, "decisions").join(listed, "transaction_id", "left_semi").select("transaction_id", "action")


@query("pred8_prefix", "SELECT transaction_id, amount_minor FROM decisions WHERE starts_with(transaction_id, 'TX00000')", ("decisions",))
def pred8(spark, folder):
    """PRED-8: ids that start with a prefix."""
    rows = load(spark, folder, "decisions").filter(F.col("transaction_id").startswith("TX00000"))
    return rows.select("transaction_id", "amount_minor")


@query(
    "pred10_decision_summary",
    f"""SELECT d.transaction_id, {_DEGRADED} AS degraded, score IS NULL AS scoreless,
               coalesce(l.status, CASE WHEN action = 'review' THEN 'open' END) AS review_status
        FROM decisions d LEFT JOIN latest l ON l.transaction_id = d.transaction_id""",
    ("decisions", "reviews"),
    {"latest": _LATEST},
)
def pred10(spark, folder):
    """PRED-10: what a list shows of each decision."""
    rows = ops.with_latest_review(load(spark, folder, "decisions"), load(spark, folder, "reviews"))
    return decide.summary(rows, F.col("latest_status")).select("transaction_id", "degraded", "scoreless", "review_status")


@query(
    "join3_decision_events",
    """SELECT d.transaction_id, o.created_us, o.published_us FROM decisions d JOIN outbox o
         ON o.aggregate_id = d.transaction_id AND o.event_type = 'decision.made'""",
    ("decisions", "outbox"),
)
def join3(spark, folder):
    """JOIN-3: decisions with their event."""
    events = load(spark, folder, "outbox").filter("event_type = 'decision.made'")
    joined = load(spark, folder, "decisions").join(events, F.col("transaction_id") == F.col("aggregate_id"))
    return joined.select("transaction_id", "created_us", "published_us")


@query(
    "join4_latest_review",
    "SELECT d.transaction_id, l.status, l.analyst, l.created_us FROM decisions d LEFT JOIN latest l ON l.transaction_id = d.transaction_id",
    ("decisions", "reviews"),
    {"latest": _LATEST},
)
def join4(spark, folder):
    """JOIN-4: each decision with its newest review."""
    rows = ops.with_latest_review(load(spark, folder, "decisions"), load(spark, folder, "reviews"))
    return rows.select("transaction_id", F.col("latest_status").alias("status"), "analyst", F.col("reviewed_us").alias("created_us"))


@query(
    "join5_foreign_owner",
    "SELECT d.transaction_id, o.stream FROM decisions d LEFT JOIN outbox o ON o.aggregate_id = d.transaction_id WHERE o.stream IS NULL OR o.stream NOT LIKE 'replay:%'",
    ("decisions", "outbox"),
)
def join5(spark, folder):
    """JOIN-5: decisions that do not belong to a replay."""
    return ops.foreign_owned(load(spark, folder, "decisions"), load(spark, folder, "outbox"), "replay:").select("transaction_id", "stream")


@query(
    "top4_decision_page",
    """SELECT transaction_id, decision_us FROM decisions WHERE (decision_us, transaction_id) < (1706400000000000, 'TX000005000')
       ORDER BY decision_us DESC, transaction_id DESC LIMIT 51""",
    ("decisions",),
)
def top4(spark, folder):
    """TOP-4: a page of decisions after a cursor, newest first."""
    rows = load(spark, folder, "decisions").select("transaction_id", "decision_us")
    return ops.page(rows, ["decision_us", "transaction_id"], (1706400000000000, "TX000005000"), 50)


@query(
    "top5_review_queue_page",
    f"""SELECT transaction_id, decision_us, priority FROM (
          SELECT d.transaction_id, d.decision_us, coalesce(d.score, -1) AS priority, coalesce(l.status, 'open') AS status
          FROM decisions d LEFT JOIN latest l ON l.transaction_id = d.transaction_id WHERE d.action = 'review' AND {_NS}) q
        WHERE status = 'open' AND (priority, decision_us, transaction_id) < (CAST(0.7 AS DOUBLE), 1706400000000000, 'TX000005000')
        ORDER BY priority DESC, decision_us DESC, transaction_id DESC LIMIT 26""",
    ("decisions", "outbox", "reviews"),
    {"latest": _LATEST},
)
def top5(spark, folder):
    """TOP-5: a page of open cases after a cursor, highest score first."""
    queue = ops.review_queue(_live(spark, folder), load(spark, folder, "reviews")).filter("status = 'open'")
    rows = queue.select("transaction_id", "decision_us", "priority")
    return ops.page(rows, ["priority", "decision_us", "transaction_id"], (0.7, 1706400000000000, "TX000005000"), 25)


@query("top6_next_batch", "SELECT id, aggregate_id FROM outbox WHERE published_us IS NULL ORDER BY id LIMIT 100", ("outbox",))
def top6(spark, folder):
    """TOP-6: the oldest unpublished events."""
    return ops.next_batch(load(spark, folder, "outbox"), 100).select("id", "aggregate_id")


@query("top7_latest_decision", "SELECT transaction_id, decision_us, action FROM decisions ORDER BY decision_us DESC, transaction_id DESC LIMIT 1", ("decisions",))
def top7(spark, folder):
    """TOP-7: the newest decision, as an aggregate."""
    newest = F.max(F.struct("decision_us", "transaction_id", "action")).alias("d")
    return load(spark, folder, "decisions").agg(newest).select("d.transaction_id", "d.decision_us", "d.action")


@query(
    "top8_first_from_cutoff",
    f"SELECT transaction_id, decision_us FROM decisions WHERE decision_us >= {NOW - 5 * DAY_US} ORDER BY decision_us, transaction_id LIMIT 300",
    ("decisions",),
)
def top8(spark, folder):
    """TOP-8: the first decisions from a cutoff on."""
    rows = load(spark, folder, "decisions").filter(F.col("decision_us") >= NOW - 5 * DAY_US)
    return rows.orderBy("decision_us", "transaction_id").limit(300).select("transaction_id", "decision_us")


@query(
    "top9_even_sample",
    """SELECT transaction_id, place FROM (SELECT transaction_id, row_number() OVER (ORDER BY decision_us, txn_id) AS place FROM decisions) t
       WHERE place - 1 IN (SELECT CAST(floor(CAST(i AS DOUBLE) * (CAST((SELECT count(*) FROM decisions) - 1 AS DOUBLE) / 99.0)) AS BIGINT) FROM range(100) r(i))""",
    ("decisions",),
)
def top9(spark, folder):
    """TOP-9: a hundred decisions at even distances."""
    rows = load(spark, folder, "decisions")
    placed = row_numbers(rows, [F.col("decision_us"), F.col("txn_id")], name="place")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ops.even_sample(placed, "place", 100, total).select("transaction_id", "place")


@query("prj4_request_ids", "SELECT concat('D17-', transaction_id) AS request_id, decision_us FROM decisions", ("decisions",))
def prj4(spark, folder):
    """PRJ-4: request ids of a replay, to be sent in decision order."""
    rows = load(spark, folder, "decisions")
    return rows.select(F.concat(F.lit("D17-"), "transaction_id").alias("request_id"), "decision_us").orderBy("decision_us", "request_id")


@query(
    "dec9_lifecycle",
    """SELECT d.transaction_id, o.created_us, o.published_us, count(r.id) AS reviews, arg_max(r.status, r.id) AS review_status
       FROM decisions d JOIN outbox o ON o.aggregate_id = d.transaction_id AND o.event_type = 'decision.made'
       LEFT JOIN reviews r ON r.transaction_id = d.transaction_id GROUP BY 1, 2, 3""",
    ("decisions", "outbox", "reviews"),
)
def dec9(spark, folder):
    """DEC-9: when each decision's event was created and published, and how its review stands."""
    rows = ops.lifecycle(load(spark, folder, "decisions"), load(spark, folder, "outbox"), load(spark, folder, "reviews"))
    return rows.select("transaction_id", "created_us", "published_us", "reviews", "review_status")


@query(
    "dec9_review_history",
    """SELECT r.transaction_id, r.id, r.status, r.disposition, r.analyst, r.created_us, d.action FROM reviews r
       JOIN decisions d ON d.transaction_id = r.transaction_id""",
    ("decisions", "reviews"),
)
def dec9_reviews(spark, folder):
    """DEC-9: all reviews of the decisions, one row each."""
    actions = load(spark, folder, "decisions").select("transaction_id", "action")
    rows = load(spark, folder, "reviews").join(actions, "transaction_id")
    return rows.select("transaction_id", "id", "status", "disposition", "analyst", "created_us", "action")


@query(
    "str5_consumer_lag",
    f"""SELECT topic, count(*) AS partitions, CAST(sum(p) AS BIGINT) AS committed,
               CASE WHEN bool_and(fresh) THEN CAST(sum(greatest(end_offset - p, 0)) AS BIGINT) END AS lag
        FROM (SELECT *, greatest(coalesce(committed_offset, 0), 0) AS p, end_offset IS NOT NULL AND {NOW + 2 * DAY_US} - fetched_us <= {7 * DAY_US} AS fresh
              FROM partitions) t GROUP BY topic""",
    ("partitions",),
)
def str5(spark, folder):
    """STR-5: unhandled messages per topic, unknown when a view is too old."""
    return ops.lag(load(spark, folder, "partitions"), NOW + 2 * DAY_US, 7 * DAY_US)


# The upper bounds of the delay histogram.
_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0)


@query(
    "str6_delay_histogram",
    " UNION ALL ".join(f"SELECT '{b}' AS le, count(*) FILTER (WHERE s <= CAST({b} AS DOUBLE)) AS n FROM t" for b in _BOUNDS) + " UNION ALL SELECT '+Inf', count(*) FROM t",
    ("txn",),
    {"t": "SELECT CAST(received_us - event_us AS DOUBLE) / 1000000 AS s FROM txn"},
)
def str6(spark, folder):
    """STR-6: how long after it happened an event was applied."""
    rows = load(spark, folder, "txn")
    return ops.delay_buckets(rows, (F.col("received_us") - F.col("event_us")).cast("double") / US, _BOUNDS)


def _health(spark, folder):
    rows = load(spark, folder, "health")
    return rows.withColumn("lag", decide.known_lag(F.col("reported_lag")))


_REASONS = """list_filter([CASE WHEN heartbeat_us IS NULL THEN 'WORKER_HEARTBEAT_MISSING' WHEN at_us - heartbeat_us > 10000000 THEN 'WORKER_HEARTBEAT_STALE' END,
    CASE WHEN at_us - oldest_us > 30000000 THEN 'OUTBOX_BACKLOG_AGED' END,
    CASE WHEN reported_lag < 0 THEN 'CONSUMER_LAG_UNKNOWN' WHEN reported_lag > 1000 THEN 'CONSUMER_LAG_HIGH' END], lambda x: x IS NOT NULL)"""


@query("dec4_pipeline_reasons", f"SELECT at_us, array_to_string({_REASONS}, ',') AS reasons FROM health", ("health",))
def dec4(spark, folder):
    """DEC-4: what was wrong with the pipeline at each check."""
    h = _health(spark, folder)
    reasons = decide.pipeline_reasons(F.col("at_us"), F.col("heartbeat_us"), F.col("oldest_us"), F.col("lag"))
    return h.select("at_us", F.array_join(reasons, ",").alias("reasons"))


_UNKNOWN = {
    "flagged": "SELECT *, heartbeat_us IS NULL OR reported_lag < 0 AS u FROM health",
    "islands": "SELECT *, u AND NOT coalesce(lag(u) OVER (PARTITION BY namespace ORDER BY at_us), FALSE) AS starts FROM flagged",
    "since": "SELECT *, CASE WHEN u THEN max(CASE WHEN starts THEN at_us END) OVER (PARTITION BY namespace ORDER BY at_us) END AS unknown_since FROM islands",
    "escalated": """SELECT *, CASE WHEN (at_us - heartbeat_us) / 1e6 > 60 OR (at_us - oldest_us) / 1e6 > 60 THEN 'PIPELINE_STALE_BEYOND_LIMIT'
                            WHEN (at_us - unknown_since) / 1e6 > 60 THEN 'PIPELINE_UNKNOWN_BEYOND_LIMIT' END AS suppress,
                           backlog_rows > 50000 OR coalesce((at_us - oldest_us) / 1e6 > 900, FALSE) AS reject FROM since""",
}


def _escalated(spark, folder):
    h = _health(spark, folder)
    h = decide.unknown_since(h, F.col("heartbeat_us").isNull() | F.col("lag").isNull())

    def age(column):
        return (F.col("at_us") - F.col(column)).cast("double") / US

    return h.withColumns(
        {
            "suppress": decide.escalation(age("heartbeat_us"), age("oldest_us"), age("unknown_since")),
            "reject": decide.rejects(F.col("backlog_rows"), age("oldest_us")),
            "reasons": decide.pipeline_reasons(F.col("at_us"), F.col("heartbeat_us"), F.col("oldest_us"), F.col("lag")),
        }
    )


@query("dec8_unknown_since", "SELECT namespace, at_us, unknown_since FROM since", ("health",), _UNKNOWN)
def dec8(spark, folder):
    """DEC-8: since when the state has been unknown."""
    return _escalated(spark, folder).select("namespace", "at_us", "unknown_since")


@query("dec5_staleness_escalation", "SELECT namespace, at_us, suppress FROM escalated", ("health",), _UNKNOWN)
def dec5(spark, folder):
    """DEC-5: when features were too stale to score on."""
    return _escalated(spark, folder).select("namespace", "at_us", "suppress")


@query("dec7_reject_on_backlog", "SELECT namespace, at_us, reject FROM escalated", ("health",), _UNKNOWN)
def dec7(spark, folder):
    """DEC-7: when new decisions were refused."""
    return _escalated(spark, folder).select("namespace", "at_us", "reject")


@query(
    "dec6_degraded_modes",
    f"""SELECT t.txn_id, CASE WHEN e.reject THEN 'reject' WHEN e.suppress IS NOT NULL THEN 'suppress' WHEN t.txn_id % 29 = 0 THEN 'no_features'
               WHEN len({_REASONS}) > 0 THEN 'degraded' ELSE 'normal' END AS mode
        FROM txn t JOIN escalated e ON e.at_us = t.received_us - t.received_us % 60000000""",
    ("txn", "health"),
    _UNKNOWN,
)
def dec6(spark, folder):
    """DEC-6: the mode in which each transaction was decided."""
    health = _escalated(spark, folder).select("at_us", "suppress", "reject", "reasons")
    minute = F.col("received_us") - F.pmod("received_us", lit(60 * US))
    rows = load(spark, folder, "txn").select("txn_id", minute.alias("at_us")).join(health, "at_us")
    mode = decide.mode(F.col("reject"), F.col("suppress"), F.col("txn_id") % 29 != 0, F.col("reasons"))
    return rows.select("txn_id", mode.alias("mode"))


@query(
    "dec1_policy",
    f"""SELECT txn_id, CASE WHEN score IS NULL THEN 'review' WHEN score >= CAST({DECLINE_AT} AS DOUBLE) THEN 'decline'
          WHEN score >= CAST({REVIEW_AT} AS DOUBLE) THEN 'review' ELSE 'approve' END AS action,
        CASE WHEN score IS NULL THEN 'NO_SCORE' WHEN score >= CAST({DECLINE_AT} AS DOUBLE) THEN 'SCORE_AT_OR_ABOVE_DECLINE_THRESHOLD'
          WHEN score >= CAST({REVIEW_AT} AS DOUBLE) THEN 'SCORE_AT_OR_ABOVE_REVIEW_THRESHOLD' ELSE 'SCORE_BELOW_REVIEW_THRESHOLD' END AS reason
        FROM decisions""",
    ("decisions",),
)
def dec1(spark, folder):
    """DEC-1: score to action and reason."""
    rows = load(spark, folder, "decisions")
    return rows.select("txn_id", decide.decide(F.col("score"), REVIEW_AT, DECLINE_AT).alias("d")).select("txn_id", "d.action", "d.reason")


@query(
    "idem1_replay_or_conflict",
    """SELECT d.seq, CASE WHEN d.seq = f.seq THEN 'new' WHEN d.payload_hash = f.payload_hash THEN 'replay' ELSE 'conflict' END AS verdict
       FROM deliveries d JOIN (SELECT event_id, arg_min(seq, (received_us, seq)) AS seq, arg_min(payload_hash, (received_us, seq)) AS payload_hash
                               FROM deliveries GROUP BY event_id) f ON f.event_id = d.event_id""",
    ("deliveries",),
)
def idem1(spark, folder):
    """IDEM-1: the first request of an id is new, an equal one replays it, another conflicts."""
    rows = load(spark, folder, "deliveries")
    return decide.first_requests(rows, "event_id", "payload_hash", ["received_us", "seq"]).select("seq", "verdict")


@query(
    "pred4_request_validation",
    """SELECT txn_id, CASE WHEN txn_id % 71 = 1 THEN 'INVALID_TRANSACTION_ID' WHEN txn_id % 71 = 2 THEN 'INVALID_AMOUNT_MINOR'
                  WHEN txn_id % 71 = 3 THEN 'INVALID_CURRENCY' WHEN txn_id % 71 = 4 THEN 'INVALID_EVENT_TIME' END AS problem FROM decisions""",
    ("decisions",),
)
def pred4(spark, folder):
    """PRED-4: the first reason to refuse each request; some are damaged here."""
    rows, m = load(spark, folder, "decisions"), F.col("txn_id") % 71
    problem = decide.request_problem(
        F.when(m == 1, F.concat("transaction_id", F.lit(" !"))).otherwise(F.col("transaction_id")),
        F.col("customer_id"),
        F.col("terminal_id"),
        F.when(m == 2, lit(-1)).otherwise(F.col("amount_minor")),
        F.when(m == 3, F.lit("EUR")).otherwise(F.lit("usd")),
        F.when(m == 4, F.lit("2024-01-02T03:04:05")).otherwise(F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
    )
    return rows.select("txn_id", problem.alias("problem"))


@query(
    "pred4_review_validation",
    """SELECT id, CASE WHEN id % 31 = 0 THEN 'INVALID_STATUS' WHEN status = 'closed' AND id % 13 = 0 THEN 'DISPOSITION_REQUIRED'
                       WHEN id % 17 = 0 THEN 'NOTE_TOO_LONG' END AS problem FROM reviews""",
    ("reviews",),
)
def pred4_reviews(spark, folder):
    """PRED-4: the same for reviews."""
    rows, i = load(spark, folder, "reviews"), F.col("id")
    problem = decide.review_problem(
        F.when(i % 31 == 0, F.lit("done")).otherwise(F.col("status")),
        F.when(i % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("disposition")),
        F.when(i % 17 == 0, F.repeat(F.lit("x"), F.lit(2001))).otherwise(F.col("note")),
    )
    return rows.select("id", problem.alias("problem"))
