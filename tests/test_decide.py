"""Policy, health and idempotency at their bounds; canonical text; messages and requests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidegate import schemas
from tidegate.functions import scalars as fn
from tidegate.functions.times import US
from tidegate.operators import decide, messages as msg
from tidegate.operators import operations as ops
from tidegate.operators import telemetry


def test_policy_bounds_are_inclusive(spark):
    review, decline, step = 0.35, 0.82, 1e-9
    scores = [None] + [limit + d for limit in (review, decline) for d in (-step, 0.0, step)] + [0.0, 1.0]
    df = spark.createDataFrame([(s,) for s in scores], "score double")

    def expected(score, limits):
        if score is None:
            return "review"
        names = ["approve", "review", "decline"]
        return names[sum(score >= limit for limit in limits)]

    for limits in ((review, decline), (review,)):
        column = decide.decide(F.col("score"), review, decline if len(limits) == 2 else None)
        got = df.select("score", column.alias("d")).collect()
        assert [r["d"]["action"] for r in got] == [expected(s, limits) for s in scores]
        assert got[0]["d"]["reason"] == "NO_SCORE"
    with pytest.raises(ValueError):
        decide.decide(F.col("score"), decline, review)


def test_staleness_bounds(spark):
    ages = [None] + [decide.STALE_LIMIT_S + d for d in (-0.25, 0.0, 0.25)]
    gaps = [None] + [decide.UNKNOWN_LIMIT_S + d for d in (-0.25, 0.0, 0.25)]
    rows = [(h, o, u) for h in ages for o in ages for u in gaps]
    df = spark.createDataFrame(rows, "h double, o double, u double")
    got = df.select("h", "o", "u", decide.escalation(F.col("h"), F.col("o"), F.col("u")).alias("e")).collect()
    for r in got:
        stale = any(a is not None and a > decide.STALE_LIMIT_S for a in (r["h"], r["o"]))
        unknown = r["u"] is not None and r["u"] > decide.UNKNOWN_LIMIT_S
        want = "PIPELINE_STALE_BEYOND_LIMIT" if stale else "PIPELINE_UNKNOWN_BEYOND_LIMIT" if unknown else None
        assert r["e"] == want, r


def test_health_reasons_are_strict(spark):
    rows = [
        (100 * US, 90 * US, 70 * US, 1000),
        (100 * US, 90 * US - 1, 70 * US - 1, 1001),
        (100 * US, None, None, None),
    ]
    df = spark.createDataFrame(rows, "now long, h long, o long, l long")
    got = [r[0] for r in df.select(decide.pipeline_reasons(*[F.col(c) for c in ("now", "h", "o", "l")])).collect()]
    assert got == [
        [],
        ["WORKER_HEARTBEAT_STALE", "OUTBOX_BACKLOG_AGED", "CONSUMER_LAG_HIGH"],
        ["WORKER_HEARTBEAT_MISSING", "CONSUMER_LAG_UNKNOWN"],
    ]


def test_mode_precedence(spark):
    rows = [(True, "x", False, ["r"]), (False, "x", False, ["r"]), (False, None, False, ["r"]), (False, None, True, ["r"]), (False, None, True, [])]
    df = spark.createDataFrame(rows, "r boolean, s string, f boolean, w array<string>")
    got = [r[0] for r in df.select(decide.mode(*[F.col(c) for c in "rsfw"])).collect()]
    assert got == ["reject", "suppress", "no_features", "degraded", "normal"]


def test_unknown_run_starts_over_chunks(spark):
    unknown = [i % 10 in (3, 4, 5) for i in range(200)]
    df = spark.createDataFrame([("n", i, u) for i, u in enumerate(unknown)], "namespace string, at_us long, u boolean")
    got = decide.unknown_since(df, F.col("u"), rows_per_chunk=15).orderBy("at_us").collect()
    want = [i - i % 10 + 3 if u else None for i, u in enumerate(unknown)]
    assert [r["unknown_since"] for r in got] == want


INSTANT = 1_747_000_000 * US
# The canonical form: sorted names, no blanks, microseconds and a Z.
LITERAL = json.dumps(
    dict(
        hash_version=1, transaction_id="order-9", customer_id="buyer-5", terminal_id="shop-3", amount_minor=807, currency="USD",
        event_time="2025-05-11T21:46:40.000000Z",
    ),
    sort_keys=True, separators=(",", ":"),
)


def test_canonical_json_and_hash(spark):
    args = [F.lit("order-9"), F.lit("buyer-5"), F.lit("shop-3"), F.lit(807).cast("bigint"), F.lit("usd"), F.lit(INSTANT)]
    row = spark.range(1).select(fn.canonical_json(*args).alias("j"), fn.payload_hash(*args).alias("h")).first()
    assert row["j"] == LITERAL and row["h"] == hashlib.sha256(LITERAL.encode()).hexdigest()


VALUE = dict(
    event_id="11111111-2222-3333-4444-555555555555", event_type="decision.made", schema_version=1,
    transaction_id="order-9", payload_hash=hashlib.sha256(LITERAL.encode()).hexdigest(), customer_id="buyer-5", terminal_id="shop-3",
    amount_minor=807, currency="USD", event_time="2025-05-11T21:46:40Z", received_at="2025-05-11T21:46:41Z",
    decision_time="2025-05-11T21:46:41Z", persisted_at="2025-05-11T21:46:42Z", action="approve", score=None,
    model_version=None, feature_version="f1", policy_version="p",
)
HEADERS = [("event_id", VALUE["event_id"].encode()), ("event_type", b"decision.made"), ("schema_version", b"1")]


def without(name):
    return {k: v for k, v in VALUE.items() if k != name}


CASES = [
    (b"buyer-5", json.dumps(VALUE), HEADERS, None),
    (b"buyer-5", json.dumps({**VALUE, "event_time": "2025-05-12T03:16:40+05:30"}), HEADERS, None),
    (b"buyer-5", json.dumps(VALUE), [], None),
    (b"buyer-5", "{not json", HEADERS, "MALFORMED_JSON"),
    (b"buyer-5", None, HEADERS, "MALFORMED_JSON"),
    (b"buyer-5", "[1]", HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps(without("score")), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "extra": 1}), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "amount_minor": "807"}), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "amount_minor": True}), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "amount_minor": 1.5}), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "amount_minor": -1}), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "schema_version": 2}), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "customer_id": 7}), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "event_time": "2025-05-11T21:46:40"}), HEADERS, "SCHEMA_VIOLATION"),
    (b"buyer-5", json.dumps({**VALUE, "currency": "EUR"}), HEADERS, "UNSUPPORTED_CURRENCY"),
    (b"buyer-6", json.dumps(VALUE), HEADERS, "KEY_MISMATCH"),
    (None, json.dumps(VALUE), HEADERS, "KEY_MISMATCH"),
    (b"buyer-5", json.dumps(VALUE), [("event_type", b"other")], "HEADER_MISMATCH"),
    (b"buyer-5", json.dumps({**VALUE, "amount_minor": 12346}), HEADERS, "PAYLOAD_HASH_MISMATCH"),
    (b"buyer-6", json.dumps({**VALUE, "currency": "EUR", "amount_minor": 1}), [], "UNSUPPORTED_CURRENCY"),
]


def test_every_message_reason_in_order(spark):
    rows = [(k, v.encode() if v is not None else None, h, "t", 0, i) for i, (k, v, h, _) in enumerate(CASES)]
    parsed = msg.parse(spark.createDataFrame(rows, schemas.MESSAGE)).checkpoint()
    got = [r["reason"] for r in parsed.orderBy("offset").collect()]
    assert got == [reason for *_, reason in CASES]
    history = msg.to_history(parsed, F.col("offset")).orderBy("seq").collect()
    assert [r["event_us"] for r in history] == [INSTANT] * 3 and history[0]["source_id"] == VALUE["event_id"]
    dead = msg.dead_letters(parsed)
    assert dead.count() == len([c for c in CASES if c[3]])
    names = [h["key"] for h in dead.filter("reason = 'KEY_MISMATCH'").first()["headers"]]
    assert names == ["dlq_reason", "source_topic", "source_partition", "source_offset", "event_id"]


REQUEST = dict(transaction_id="tx-1", customer_id="c-1", terminal_id="t-1", amount_minor=5, currency="usd", event_time="2026-01-02T03:04:05Z")


@pytest.mark.parametrize(
    "change,problem",
    [
        ({}, None),
        ({"event_time": "2025-05-11T21:46:40"}, "INVALID_EVENT_TIME"),
        ({"amount_minor": 123.0}, "SCHEMA_VIOLATION"),
        ({"amount_minor": "5"}, "SCHEMA_VIOLATION"),
        ({"amount_minor": True}, "SCHEMA_VIOLATION"),
        ({"amount_minor": -1}, "INVALID_AMOUNT_MINOR"),
        ({"amount_minor": 10**12}, None),
        ({"amount_minor": 10**12 + 1}, "INVALID_AMOUNT_MINOR"),
        ({"currency": "EUR"}, "INVALID_CURRENCY"),
        ({"transaction_id": ""}, "INVALID_TRANSACTION_ID"),
        ({"transaction_id": "has space"}, "INVALID_TRANSACTION_ID"),
        ({"extra": 1}, "SCHEMA_VIOLATION"),
    ],
)
def test_requests(spark, change, problem):
    got = msg.parse_requests(spark.createDataFrame([(json.dumps({**REQUEST, **change}),)], "value string")).first()
    assert got["problem"] == problem
    if problem is None:
        assert got["request"]["currency"] == "USD"


def test_reviews_need_a_disposition_to_close(spark):
    rows = [("closed", None, None), ("closed", "suspected_fraud", None), ("open", None, "x" * 2001), ("done", None, None)]
    df = spark.createDataFrame(rows, "s string, d string, n string")
    got = [r[0] for r in df.select(decide.review_problem(F.col("s"), F.col("d"), F.col("n"))).collect()]
    assert got == ["DISPOSITION_REQUIRED", None, "NOTE_TOO_LONG", "INVALID_STATUS"]


PAGE = """# HELP x
responses_total{status="201"} %s
responses_total{status="503"} %s
request_seconds_bucket{le="0.01",stage="request_total"} %s
request_seconds_bucket{le="0.025",stage="request_total"} %s
request_seconds_bucket{le="+Inf",stage="request_total"} %s
request_seconds_bucket{le="0.01",stage="inference"} 99
broken line
"""


def test_rates_and_bound_between_scrapes(spark):
    pages = [(0, PAGE % (100, 1, 90, 100, 101)), (10 * US, PAGE % (190, 11, 150, 190, 201)), (20 * US, PAGE % (5, 0, 5, 5, 5))]
    scrapes = telemetry.samples(spark.createDataFrame(pages, "scrape_us long, text string"))
    changes = telemetry.deltas(scrapes, 15 * US).checkpoint()
    rates = telemetry.rates(changes, "responses_total").collect()
    # The last scrape follows a restart: its counters went backwards, so it has no row.
    assert [(r["scrape_us"], r["requests"], r["per_second"], r["errors"], r["error_rate"]) for r in rates] == [(10 * US, 100, 10.0, 10, 0.1)]
    cells = telemetry.bucket_cells(changes, "request_seconds_bucket", ["scrape_us"], stage="request_total")
    first = cells.filter(F.col("scrape_us") == 10 * US)
    assert telemetry.histogram_bound(first, 0.95, ["scrape_us"]).first()["bound"] is None
    assert telemetry.histogram_bound(first, 0.9, ["scrape_us"]).first()["bound"] == 0.025


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(i // 3, f"id{i:02d}") for i in range(20)], "decision_us long, transaction_id string")
    keys, seen, after = ["decision_us", "transaction_id"], [], None
    while True:
        page = ops.page(rows, keys, after, 6).collect()
        seen += [r["transaction_id"] for r in page[:6]]
        if len(page) <= 6:
            break
        after = (page[5]["decision_us"], page[5]["transaction_id"])
    assert seen == [f"id{i:02d}" for i in reversed(range(20))]


def test_lag_is_unknown_when_a_view_is_missing_or_old(spark):
    rows = [("a", 10, 4, 100), ("a", 5, None, 100), ("b", None, 1, 100), ("b", 9, 1, 100), ("c", 9, 1, 10)]
    df = spark.createDataFrame(rows, "topic string, end_offset long, committed_offset long, fetched_us long")
    got = {r["topic"]: r["lag"] for r in ops.lag(df, 110, 20).collect()}
    assert got == {"a": 11, "b": None, "c": None}
