"""Turning scores and pipeline health into actions with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.times import US, lit
from tidegate.plans.ordered import ROWS_PER_CHUNK, Chunked, chunked, running

# Limits of the health rules.
HEARTBEAT_MAX_AGE_US = 10 * US
OUTBOX_MAX_AGE_US = 30 * US
LAG_MAX_EVENTS = 1000
STALE_LIMIT_S = 60.0
UNKNOWN_LIMIT_S = 60.0
REJECT_ROWS = 50_000
REJECT_AGE_S = 900.0
# Codes of a decision that was made without full information.
DEGRADED_CODES = (
    "PIPELINE_DEGRADED",
    "FEATURES_UNAVAILABLE",
    "PIPELINE_STALE_BEYOND_LIMIT",
    "PIPELINE_UNKNOWN_BEYOND_LIMIT",
)


def decide(score: Column, review: float, decline: float | None) -> Column:
    """struct(action, reason); limits are inclusive, and a missing score is never approved."""
    if not 0.0 <= review <= (1.0 if decline is None else decline) <= 1.0:
        raise ValueError("limits must lie between 0 and 1, and that of review not above that of decline")

    def outcome(action: str, reason: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))

    out = F.when(score.isNull(), outcome("review", "NO_SCORE"))
    if decline is not None:
        out = out.when(score >= float(decline), outcome("decline", "SCORE_AT_OR_ABOVE_DECLINE_THRESHOLD"))
    out = out.when(score >= float(review), outcome("review", "SCORE_AT_OR_ABOVE_REVIEW_THRESHOLD"))
    return out.otherwise(outcome("approve", "SCORE_BELOW_REVIEW_THRESHOLD"))


def pipeline_reasons(now_us: Column, heartbeat_us: Column, oldest_us: Column, lag: Column) -> Column:
    """What is wrong with the pipeline, empty when healthy; a limit itself is still healthy."""
    return F.array_compact(
        F.array(
            F.when(heartbeat_us.isNull(), F.lit("WORKER_HEARTBEAT_MISSING")).when(
                now_us - heartbeat_us > HEARTBEAT_MAX_AGE_US, F.lit("WORKER_HEARTBEAT_STALE")
            ),
            F.when(now_us - oldest_us > OUTBOX_MAX_AGE_US, F.lit("OUTBOX_BACKLOG_AGED")),
            F.when(lag.isNull(), F.lit("CONSUMER_LAG_UNKNOWN")).when(
                lag > LAG_MAX_EVENTS, F.lit("CONSUMER_LAG_HIGH")
            ),
        )
    )


def known_lag(reported: Column) -> Column:
    """A reported lag of -1 means that it is not known yet."""
    return F.when(reported >= 0, reported)


def escalation(heartbeat_age_s: Column, oldest_age_s: Column, unknown_for_s: Column) -> Column:
    """Why features are too stale to score on, or null. Stale is named before unknown."""
    stale = F.coalesce(heartbeat_age_s > STALE_LIMIT_S, F.lit(False)) | F.coalesce(
        oldest_age_s > STALE_LIMIT_S, F.lit(False)
    )
    return F.when(stale, F.lit("PIPELINE_STALE_BEYOND_LIMIT")).when(
        unknown_for_s > UNKNOWN_LIMIT_S, F.lit("PIPELINE_UNKNOWN_BEYOND_LIMIT")
    )


def rejects(backlog_rows: Column, oldest_age_s: Column) -> Column:
    """Whether new decisions are refused because too much is unpublished."""
    return (backlog_rows > REJECT_ROWS) | F.coalesce(oldest_age_s > REJECT_AGE_S, F.lit(False))


def mode(reject: Column, suppress: Column, features_ok: Column, reasons: Column) -> Column:
    """Precedence of the degraded modes: reject, no scoring, no features, degraded, normal."""
    return (
        F.when(reject, F.lit("reject"))
        .when(suppress.isNotNull(), F.lit("suppress"))
        .when(~features_ok, F.lit("no_features"))
        .when(F.size(reasons) > 0, F.lit("degraded"))
        .otherwise(F.lit("normal"))
    )


def unknown_since(
    health: DataFrame, unknown: Column, key: str = "namespace", at: str = "at_us", rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Add `unknown_since`: when the current run of unknown states began, null while known."""
    rows = health.withColumn("_u", unknown)
    chunks = chunked(rows, [F.col(at)], rows_per_chunk)
    # The newest earlier instant carries its state in the last bit.
    marked = running(
        chunks,
        [F.col(at)],
        {"_previous": ("max", F.col(at) * 2 + F.col("_u").cast("bigint"))},
        keys=[key],
        inclusive=False,
    )
    starts = F.col("_u") & (F.col("_previous").isNull() | (F.pmod("_previous", lit(2)) == 0))
    started = running(
        Chunked(marked, chunks.column, chunks.single),
        [F.col(at)],
        {"unknown_since": ("max", F.when(starts, F.col(at)))},
        keys=[key],
    )
    since = F.when(F.col("_u"), F.col("unknown_since"))
    return started.withColumn("unknown_since", since).select(*health.columns, "unknown_since")


def first_requests(requests: DataFrame, key: str, payload: str, order: list[str]) -> DataFrame:
    """Verdict per request: the first of an id is new, an equal payload replays it, another conflicts."""
    first = requests.groupBy(key).agg(
        F.min(F.struct(*order)).alias("_at"), F.min_by(payload, F.struct(*order)).alias("_first")
    )
    joined = requests.join(first, key)
    verdict = (
        F.when(F.struct(*order) == F.col("_at"), F.lit("new"))
        .when(F.col(payload) == F.col("_first"), F.lit("replay"))
        .otherwise(F.lit("conflict"))
    )
    return joined.withColumn("verdict", verdict).drop("_at", "_first")


def degraded(score: Column, reasons: Column) -> Column:
    codes = F.array(*[F.lit(c) for c in DEGRADED_CODES])
    return score.isNull() | F.arrays_overlap(reasons, codes)


def summary(decisions: DataFrame, review_status: Column) -> DataFrame:
    """What a list shows of a decision: flags and the status an unreviewed case has."""
    opened = F.when(F.col("action") == "review", F.lit("open"))
    return decisions.select(
        "*",
        degraded(F.col("score"), F.col("reason_codes")).alias("degraded"),
        F.col("score").isNull().alias("scoreless"),
        F.coalesce(review_status, opened).alias("review_status"),
    )


def request_problem(
    transaction_id: Column, customer_id: Column, terminal_id: Column, amount: Column, currency: Column, event_time: Column
) -> Column:
    """First reason to refuse a request, or null. The time must name its offset."""
    identifier = r"^[A-Za-z0-9_\-]{1,64}$"
    out = F.lit(None).cast("string")
    checks = [
        ("transaction_id", F.coalesce(transaction_id.rlike(identifier), F.lit(False))),
        ("customer_id", F.coalesce(customer_id.rlike(identifier), F.lit(False))),
        ("terminal_id", F.coalesce(terminal_id.rlike(identifier), F.lit(False))),
        ("amount_minor", F.coalesce(amount.between(0, 10**12), F.lit(False))),
        ("currency", F.coalesce(F.upper(currency).isin("USD"), F.lit(False))),
        (
            "event_time",
            F.coalesce(
                event_time.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(event_time).isNotNull(), F.lit(False)
            ),
        ),
    ]
    for name, ok in reversed(checks):
        out = F.when(~ok, F.lit(f"INVALID_{name.upper()}")).otherwise(out)
    return out


def review_problem(status: Column, disposition: Column, note: Column) -> Column:
    """Why a review may not be appended, or null."""
    return (
        F.when(~F.coalesce(status.isin("open", "in_review", "closed"), F.lit(False)), F.lit("INVALID_STATUS"))
        .when((status == "closed") & disposition.isNull(), F.lit("DISPOSITION_REQUIRED"))
        .when(
            ~disposition.isin("suspected_fraud", "likely_legitimate", "needs_more_information"),
            F.lit("INVALID_DISPOSITION"),
        )
        .when(F.length(note) > 2000, F.lit("NOTE_TOO_LONG"))
    )
