"""The decision.made message: building it, parsing it, and the reason a bad one is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalars import canonical_json, compact_json, header_map
from tidegate.functions.times import format_utc, micros
from tidegate.operators.decide import request_problem
from tidegate.schemas import DECISION_MADE, TXN_EVENT

# Fixed values of message version 1.
EVENT_TYPE = "decision.made"
SCHEMA_VERSION = 1
REASONS = (
    "MALFORMED_JSON",
    "SCHEMA_VIOLATION",
    "UNSUPPORTED_CURRENCY",
    "KEY_MISMATCH",
    "HEADER_MISMATCH",
    "PAYLOAD_HASH_MISMATCH",
)
_IDENTIFIER = r"^[A-Za-z0-9_\-]{1,64}$"
_UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
_TIMES = ("event_time", "received_at", "decision_time", "persisted_at")
_TEXT = [f.name for f in DECISION_MADE if f.dataType.simpleString() == "string" and f.name != "model_version"]


def event_payload(event_id: Column) -> Column:
    """The message value of a stored decision."""
    return compact_json(
        event_id=event_id,
        event_type=F.lit(EVENT_TYPE),
        schema_version=F.lit(SCHEMA_VERSION),
        transaction_id=F.col("transaction_id"),
        payload_hash=F.col("payload_hash"),
        customer_id=F.col("customer_id"),
        terminal_id=F.col("terminal_id"),
        amount_minor=F.col("amount_minor"),
        currency=F.col("currency"),
        event_time=format_utc("event_us"),
        received_at=format_utc("received_us"),
        decision_time=format_utc("decision_us"),
        persisted_at=format_utc("persisted_us"),
        action=F.col("action"),
        score=F.col("score"),
        model_version=F.col("model_version"),
        feature_version=F.col("feature_version"),
        policy_version=F.col("policy_version"),
    )


def to_messages(decisions: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Key, value and headers of the messages to publish; the key keeps a customer in one partition."""
    headers = F.array(
        *[
            F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))
            for name, value in (
                ("event_id", F.col(event_id)),
                ("event_type", F.lit(EVENT_TYPE)),
                ("schema_version", F.lit(str(SCHEMA_VERSION))),
            )
        ]
    )
    return decisions.select(
        F.col("customer_id").cast("binary").alias("key"),
        event_payload(F.col(event_id)).cast("binary").alias("value"),
        headers.alias("headers"),
    )


def parse(messages: DataFrame) -> DataFrame:
    """Add `event` (the parsed value) and `reason` (null when valid) to key, value, headers.

    The same expressions serve batch and streaming frames. Reasons are checked in a fixed order.
    """
    text = F.col("value").cast("string")
    typed = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in DECISION_MADE) + ",_corrupt:string>"
    none = F.array().cast("array<struct<key:string,value:binary>>")
    # Generated columns are computed once per message, however many checks read them.
    once = F.struct(
        F.try_parse_json(text).alias("_doc"),
        F.from_json(text, typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("event"),
        F.json_object_keys(text).alias("_keys"),
        header_map(F.coalesce(F.col("headers"), none)).alias("_headers"),
        F.get_json_object(text, "$.event_id").alias("claimed_event_id"),
    )
    rows = messages.select("*", F.inline(F.array(once)))
    reason = (
        F.when(F.col("_doc").isNull(), F.lit("MALFORMED_JSON"))
        .when(~F.coalesce(_well_formed(), F.lit(False)), F.lit("SCHEMA_VIOLATION"))
        .when(F.col("event.currency") != "USD", F.lit("UNSUPPORTED_CURRENCY"))
        .when(~F.col("key").cast("string").eqNullSafe(F.col("event.customer_id")), F.lit("KEY_MISMATCH"))
        .when(_header_differs(), F.lit("HEADER_MISMATCH"))
        .when(_recomputed() != F.col("event.payload_hash"), F.lit("PAYLOAD_HASH_MISMATCH"))
    )
    # The verdict is generated as well, so that a filter on it does not repeat the checks.
    return rows.select(*messages.columns, "event", "claimed_event_id", F.explode(F.array(reason)).alias("reason"))


def _well_formed() -> Column:
    """Exactly the declared fields, with the declared JSON types and patterns."""
    names = F.array(*[F.lit(f.name) for f in DECISION_MADE])
    same_fields = (F.size(F.array_except(names, F.col("_keys"))) == 0) & (F.size(F.array_except(F.col("_keys"), names)) == 0)
    ok = F.col("_keys").isNotNull() & same_fields & F.col("event._corrupt").isNull()
    for name in _TEXT:
        kind = F.schema_of_variant(F.try_variant_get("_doc", f"$.{name}", "variant"))
        ok = ok & (kind == "STRING")
    event = F.col("event")
    ok = ok & event["event_id"].rlike(_UUID)
    ok = ok & (event["event_type"] == EVENT_TYPE) & (event["schema_version"] == SCHEMA_VERSION)
    ok = ok & event["payload_hash"].rlike("^[0-9a-f]{64}$")
    for name in ("transaction_id", "customer_id", "terminal_id"):
        ok = ok & event[name].rlike(_IDENTIFIER)
    ok = ok & (event["amount_minor"] >= 0) & event["action"].isin("approve", "review", "decline")
    for name in _TIMES:
        # A time must name its offset.
        ok = ok & event[name].rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(event[name]).isNotNull()
    return ok


# The fields of a decision request.
_REQUEST = {
    "transaction_id": "string",
    "customer_id": "string",
    "terminal_id": "string",
    "amount_minor": "bigint",
    "currency": "string",
    "event_time": "string",
}


def parse_requests(rows: DataFrame, text: str = "value") -> DataFrame:
    """Add `request` (currency in upper case) and `problem` (null when valid) to raw JSON requests.

    Amounts must be JSON integers, times must name their offset, and no other field is allowed.
    """
    typed = "struct<" + ",".join(f"{n}:{t}" for n, t in _REQUEST.items()) + ",_corrupt:string>"
    raw = F.col(text).cast("string")
    once = F.struct(
        F.try_parse_json(raw).alias("_doc"),
        F.from_json(raw, typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("request"),
        F.json_object_keys(raw).alias("_keys"),
    )
    names = F.array(*[F.lit(n) for n in _REQUEST])
    request, keys = F.col("request"), F.col("_keys")
    shaped = keys.isNotNull() & (F.size(F.array_except(names, keys)) == 0) & (F.size(F.array_except(keys, names)) == 0)
    shaped = shaped & request["_corrupt"].isNull()
    for name, kind in _REQUEST.items():
        if kind == "string":
            found = F.schema_of_variant(F.try_variant_get("_doc", f"$.{name}", "variant"))
            shaped = shaped & (found == "STRING")
    problem = (
        F.when(F.col("_doc").isNull(), F.lit("MALFORMED_JSON"))
        .when(~F.coalesce(shaped, F.lit(False)), F.lit("SCHEMA_VIOLATION"))
        .otherwise(request_problem(*[request[n] for n in _REQUEST]))
    )
    parsed = rows.select("*", F.inline(F.array(once)))
    upper = F.struct(*[F.upper(request[n]).alias(n) if n == "currency" else request[n].alias(n) for n in _REQUEST])
    return parsed.select(*rows.columns, upper.alias("request"), F.explode(F.array(problem)).alias("problem"))


def _header_differs() -> Column:
    expected = {
        "event_id": F.lower(F.col("event.event_id")),
        "event_type": F.lit(EVENT_TYPE),
        "schema_version": F.lit(str(SCHEMA_VERSION)),
    }
    out = F.lit(False)
    for name, value in expected.items():
        out = out | F.coalesce(F.element_at("_headers", name) != value, F.lit(False))
    return out


def _recomputed() -> Column:
    event = F.col("event")
    return F.sha2(
        canonical_json(
            event["transaction_id"],
            event["customer_id"],
            event["terminal_id"],
            event["amount_minor"],
            event["currency"],
            micros(F.try_to_timestamp(event["event_time"])),
        ),
        256,
    )


def delivery() -> Column:
    """One number for a message of a topic: offsets start anew in each partition, so both are part of it."""
    return F.shiftleft(F.col("partition").cast("bigint"), 47) + F.col("offset")


def to_history(parsed: DataFrame, seq: Column) -> DataFrame:
    """Valid messages as rows of the feature history; the transaction id is the event id."""
    return parsed.filter(F.col("reason").isNull()).select(*_history_fields(seq))


_LETTER = ("key", "value", "topic", "partition", "offset", "claimed_event_id")


def sorted_out(parsed: DataFrame, seq: Column) -> DataFrame:
    """Each message once: a valid one with its fields of the feature history, a refused one with those of a dead letter."""
    refused = F.col("reason").isNotNull()
    fields = [F.when(~refused, c).alias(name) for c, name in zip(_history_fields(seq), TXN_EVENT.fieldNames(), strict=True)]
    return parsed.select(*fields, *[F.when(refused, F.col(c)).alias(c) for c in _LETTER], "reason")


def letters(parsed: DataFrame) -> DataFrame:
    """What dead letters take of refused messages."""
    return parsed.filter(F.col("reason").isNotNull()).select(*_LETTER, "reason")


def _history_fields(seq: Column) -> list[Column]:
    event = F.col("event")
    return [
        seq.alias("seq"),
        event["transaction_id"].alias("event_id"),
        event["customer_id"].alias("customer_id"),
        event["terminal_id"].alias("terminal_id"),
        event["amount_minor"].alias("amount_minor"),
        micros(F.try_to_timestamp(event["event_time"])).alias("event_us"),
        micros(F.try_to_timestamp(event["received_at"])).alias("received_us"),
        event["payload_hash"].alias("payload_hash"),
        event["event_id"].alias("source_id"),
    ]


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Refused messages as they came, with the reason and where they came from as headers."""
    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))

    claimed = F.col("claimed_event_id")
    headers = F.array_compact(
        F.array(
            header("dlq_reason", F.col("reason")),
            header("source_topic", F.coalesce("topic", F.lit(""))),
            header("source_partition", F.col("partition")),
            header("source_offset", F.col("offset")),
            F.when(claimed.isNotNull(), header("event_id", claimed)),
        )
    )
    return parsed.filter(F.col("reason").isNotNull()).select("key", "value", headers.alias("headers"), "reason")
