"""Operational questions about decisions, the outbox, reviews and delivery progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.times import DAY, HOUR, MINUTE, US, bucket, lit
from tidegate.operators.decide import degraded
from tidegate.plans.quantiles import exact_percentiles

# Ranges a list may cover, with the bucket of their activity chart.
RANGES = {
    "15m": (15 * MINUTE, 30 * US),
    "1h": (HOUR, MINUTE),
    "6h": (6 * HOUR, 5 * MINUTE),
    "24h": (DAY, 15 * MINUTE),
}
MAX_PAGE = 100
REVIEW_STATUSES = ("open", "in_review", "closed")


def in_namespace(decisions: DataFrame, outbox: DataFrame, namespace: str) -> DataFrame:
    """Decisions whose event belongs to the namespace."""
    own = outbox.filter((F.col("event_type") == "decision.made") & (F.col("stream") == namespace))
    return decisions.join(own.select(F.col("aggregate_id").alias("transaction_id")), "transaction_id", "left_semi")


def since(rows: DataFrame, range_key: str, now_us: int) -> DataFrame:
    return rows.filter(F.col("decision_us") >= now_us - RANGES[range_key][0])


def _counts() -> list[Column]:
    score = F.col("score")
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("action") == a).alias(a) for a in ("approve", "review", "decline")],
        F.count_if(score.isNull()).alias("scoreless"),
        F.count_if(degraded(score, F.col("reason_codes"))).alias("degraded"),
    ]


def activity(decisions: DataFrame, step_us: int) -> DataFrame:
    return decisions.groupBy(bucket(F.col("decision_us"), step_us).alias("bucket_us")).agg(*_counts())


def activity_totals(buckets: DataFrame) -> DataFrame:
    names = ("total", "approve", "review", "decline", "scoreless", "degraded")
    return buckets.agg(*[F.sum(c).alias(c) for c in names])


def matching(
    decisions: DataFrame, action: str | None = None, scored: bool | None = None, is_degraded: bool | None = None
) -> DataFrame:
    """The optional filters of a decision list."""
    out = decisions
    if action is not None:
        out = out.filter(F.col("action") == action)
    if scored is not None:
        out = out.filter(F.col("score").isNotNull() if scored else F.col("score").isNull())
    if is_degraded is not None:
        flag = degraded(F.col("score"), F.col("reason_codes"))
        out = out.filter(flag if is_degraded else ~flag)
    return out


def page(rows: DataFrame, keys: Sequence[str], after: Sequence[object] | None = None, limit: int = 50) -> DataFrame:
    """The next rows in descending order of `keys`, one more than asked for to show that there are more.

    A page has 1 to MAX_PAGE rows; another limit is refused.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}")
    out = rows
    if after is not None:
        mark = F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)])
        out = out.filter(F.struct(*keys) < mark)
    return out.orderBy(*[F.col(k).desc() for k in keys]).limit(limit + 1)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The newest review of each decision, combined before the shuffle instead of sorted after it."""
    newest = F.max_by(F.struct("status", "disposition", "analyst", "created_us"), "id").alias("r")
    return reviews.groupBy("transaction_id").agg(newest).select("transaction_id", "r.*")


def with_latest_review(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    latest = latest_reviews(reviews).withColumnsRenamed(
        {"status": "latest_status", "created_us": "reviewed_us"}
    )
    return decisions.join(latest, "transaction_id", "left")


def review_queue(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Decisions to review with their status; scoreless ones have the lowest priority."""
    rows = with_latest_review(decisions.filter(F.col("action") == "review"), reviews)
    return rows.withColumns(
        {
            "priority": F.coalesce("score", F.lit(-1.0)),
            "status": F.coalesce("latest_status", F.lit("open")),
        }
    )


def status_counts(queue: DataFrame) -> DataFrame:
    """Cases per status, with a zero for a status nobody has."""
    counts = queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in REVIEW_STATUSES])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in REVIEW_STATUSES]))
    )


def lifecycle(decisions: DataFrame, outbox: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per decision when its event was created and published, and how its review stands."""
    events = outbox.filter(F.col("event_type") == "decision.made").select(
        F.col("aggregate_id").alias("transaction_id"), "created_us", "published_us", "stream"
    )
    counts = reviews.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("reviews"), F.max_by("status", "id").alias("review_status")
    )
    return (
        decisions.join(events, "transaction_id")
        .join(counts, "transaction_id", "left")
        .withColumn("reviews", F.coalesce("reviews", lit(0)))
    )


def identities(decisions: DataFrame) -> DataFrame:
    keys = ["model_version", "policy_version", "model_registry_ref"]
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def matches_identity(decisions: DataFrame, model: str, policy: str, registry: str) -> DataFrame:
    same = (
        F.col("model_version").eqNullSafe(F.lit(model))
        & F.col("policy_version").eqNullSafe(F.lit(policy))
        & F.col("model_registry_ref").eqNullSafe(F.lit(registry))
    )
    return decisions.agg(F.bool_and(same).alias("consistent"), F.count_if(~same).alias("different"))


def backlog(outbox: DataFrame, now_us: int, stream: str | None = None) -> DataFrame:
    waiting = F.col("published_us").isNull()
    if stream is not None:
        waiting = waiting & (F.col("stream") == stream)
    oldest = F.min("created_us")
    return outbox.filter(waiting).agg(
        F.count(F.lit(1)).alias("waiting"),
        oldest.alias("oldest_us"),
        ((F.lit(now_us) - oldest).cast("double") / US).alias("age_s"),
    )


def next_batch(outbox: DataFrame, size: int) -> DataFrame:
    return outbox.filter(F.col("published_us").isNull()).orderBy("id").limit(size)


def foreign_owned(decisions: DataFrame, outbox: DataFrame, own_prefix: str) -> DataFrame:
    """Decisions without an event, or with one of a stream that does not start with the prefix."""
    streams = outbox.select(F.col("aggregate_id").alias("transaction_id"), "stream")
    joined = decisions.join(streams, "transaction_id", "left")
    return joined.filter(F.col("stream").isNull() | ~F.col("stream").startswith(own_prefix))


def delays(rows: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """p50, p95, p99, largest and mean delay in milliseconds."""
    timed = rows.withColumn("ms", (F.col(end) - F.col(start)).cast("double") / 1000.0).filter("ms IS NOT NULL")
    q = exact_percentiles(timed, F.col("ms"), (0.5, 0.95, 0.99), keys)
    q = q.withColumnsRenamed({"q0": "p50", "q1": "p95", "q2": "p99"})
    rest = timed.groupBy(*keys, lit(0).alias("_one")).agg(F.max("ms").alias("max_ms"), F.avg("ms").alias("mean_ms"))
    return q.withColumn("_one", lit(0)).join(rest, [*keys, "_one"]).drop("_one")


def lag(offsets: DataFrame, now_us: int, stale_after_us: int) -> DataFrame:
    """Unhandled messages over all partitions; null when a partition is unknown or its view is old."""
    progress = F.greatest(F.coalesce("committed_offset", lit(0)), lit(0))
    behind = F.greatest(F.col("end_offset") - progress, lit(0))
    fresh = F.col("end_offset").isNotNull() & F.coalesce(
        lit(now_us) - F.col("fetched_us") <= stale_after_us, F.lit(False)
    )
    return offsets.groupBy("topic").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.sum(progress).alias("committed"),
        F.when(F.bool_and(fresh), F.sum(behind)).alias("lag"),
    )


def delay_buckets(rows: DataFrame, seconds: Column, bounds: Sequence[float]) -> DataFrame:
    """Cumulative histogram: rows at or below each bound, and all of them under +Inf."""
    counts = rows.agg(
        *[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(seconds).alias("all")
    )
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(F.inline(F.array(*cells, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))))


def outcome(status: Column, score: Column, reasons: Column, error: Column) -> Column:
    """Class of a response: served, degraded, refused or failed."""
    return (
        F.when((status == 503) & (error == "pipeline_backlog_limit"), F.lit("backlog_rejected"))
        .when(~status.isin(200, 201), F.concat(F.lit("http_"), status.cast("string")))
        .when(score.isNull() | F.array_contains(reasons, "FEATURES_UNAVAILABLE"), F.lit("degraded_review_no_score"))
        .when(F.array_contains(reasons, "PIPELINE_DEGRADED"), F.lit("model_scored_pipeline_degraded"))
        .otherwise(F.lit("model_scored"))
    )


def job_outcome(status: Column, score: Column, action: Column) -> Column:
    """Class of a demo request: replayed, reviewed without a score, or its action."""
    return (
        F.when(status == 200, F.lit("idempotent_replay"))
        .when((status == 201) & score.isNull(), F.lit("scoreless_review"))
        .when(status == 201, action)
        .otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )


def passes(p95: Column, p99: Column, rps: Column, failed: Column, scheduled: Column) -> Column:
    """The serving criterion of a load run."""
    return (p95 <= 100) & (p99 <= 200) & (rps >= 99) & (failed / scheduled <= 0.001)


def next_offset(jobs: DataFrame, keys: Sequence[str] = ("namespace",)) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.coalesce(F.max(F.col("start_offset") + F.col("sent")), lit(0)).alias("next_offset"))


def even_sample(rows: DataFrame, rank: str, size: int, total: Column) -> DataFrame:
    """`size` rows at even distances of a 1-based rank; both ends are part of the sample."""
    step = (total - 1).cast("double") / F.lit(float(max(size - 1, 1)))
    at = (F.col(rank) - 1).cast("double")
    # The first sample number whose position reaches this row, as the positions are cut to whole rows.
    number = F.when(step > 0, F.ceil(at / step)).otherwise(F.lit(0))  # one row is its own sample
    hit = lambda i: (i >= 0) & (i <= size - 1) & (F.floor(i.cast("double") * step) == at)
    return rows.filter(hit(number) | hit(number - 1) | hit(number + 1))


def distinct_sketches(rows: DataFrame, keys: Sequence[str], value: str, precision: int = 14) -> DataFrame:
    """Per key a sketch of its distinct non-null values: 2 ** precision registers at most, however many values.

    Stored per day or batch, sketches answer for any union of them without a second look at the rows."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Approximate distinct counts of the union of sketches per key, within about 1.04 / 2 ** (precision / 2)."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("_s")).select(*keys, F.hll_sketch_estimate("_s").alias("distinct_values"))
