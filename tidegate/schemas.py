"""Column contracts of the tables the operators read, and the check that enforces them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_L, _S, _D, _B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


EVENTS = T.StructType(
    [
        T.StructField("event_id", _L),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", _L),
        T.StructField("event_type", _S),
        T.StructField("value", _D),
        T.StructField("props", _S),
    ]
)

TRANSACTIONS = _schema(
    transaction_id=_S,
    customer_id=_S,
    terminal_id=_S,
    amount_minor=_L,
    currency=_S,
    event_us=_L,
    received_us=_L,
    label_available_us=_L,
    is_fraud=_B,
    fraud_s1=_B,
    fraud_s2=_B,
    fraud_s3=_B,
)

TXN_EVENT = _schema(
    seq=_L,
    event_id=_S,
    customer_id=_S,
    terminal_id=_S,
    amount_minor=_L,
    event_us=_L,
    received_us=_L,
    payload_hash=_S,
    source_id=_S,
)

# The value of a decision.made message, version 1.
DECISION_MADE = _schema(
    event_id=_S,
    event_type=_S,
    schema_version=T.IntegerType(),
    transaction_id=_S,
    payload_hash=_S,
    customer_id=_S,
    terminal_id=_S,
    amount_minor=_L,
    currency=_S,
    event_time=_S,
    received_at=_S,
    decision_time=_S,
    persisted_at=_S,
    action=_S,
    score=_D,
    model_version=_S,
    feature_version=_S,
    policy_version=_S,
)

MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField(
            "headers",
            T.ArrayType(T.StructType([T.StructField("key", _S), T.StructField("value", T.BinaryType())])),
        ),
        T.StructField("topic", _S),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", _L),
    ]
)

REVIEWS = _schema(
    id=_L, transaction_id=_S, status=_S, disposition=_S, note=_S, analyst=_S, created_us=_L
)


class SchemaMismatch(ValueError):
    """A table does not have the columns an operator was declared for."""


def validate(df: DataFrame, schema: T.StructType, extra: bool = True) -> DataFrame:
    """Raise before execution if a declared column is absent or has another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name}: want {f.dataType.simpleString()}, have "
        + (have[f.name].simpleString() if f.name in have else "nothing")
        for f in schema
        if have.get(f.name) != f.dataType
    ]
    if not extra:
        wrong += [f"{name}: not declared" for name in have if name not in schema.fieldNames()]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    return df
