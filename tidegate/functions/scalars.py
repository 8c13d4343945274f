"""Small expressions: text, hashing, numbers, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.times import format_utc

# Fixed value: version of the canonical payload.
HASH_VERSION = 1


def compact_json(**fields: Column) -> Column:
    """Compact JSON with the keys in sorted order."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def canonical_json(
    transaction_id: Column,
    customer_id: Column,
    terminal_id: Column,
    amount_minor: Column,
    currency: Column,
    event_us: Column,
) -> Column:
    """The text whose hash identifies a transaction payload."""
    return compact_json(
        hash_version=F.lit(HASH_VERSION),
        transaction_id=transaction_id,
        customer_id=customer_id,
        terminal_id=terminal_id,
        amount_minor=amount_minor,
        currency=F.upper(currency),
        event_time=format_utc(event_us),
    )


def payload_hash(*fields: Column) -> Column:
    return F.sha2(canonical_json(*fields), 256)


def padded_id(prefix: str, width: int, number: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def normalise_text(text: Column) -> Column:
    """Without emphasis marks, and with one space where there was any white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\*", ""), r"\s+", " "))


def round_half_up(value: Column, digits: int) -> Column:
    return F.round(value.cast("decimal(30,12)"), digits).cast("double")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column, floor: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.log(q / (F.lit(1.0) - q))


def standardise(x: Column, mean: float, scale: float) -> Column:
    return (x - F.lit(mean)) / F.lit(scale if scale > 0 else 1.0)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def or_zero(x: Column) -> Column:
    """Missing in either spelling counts as zero."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / max(whole, 1), the convention of every rate in the reports."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def join_reasons(*groups: Column) -> Column:
    """Reason codes of scorer, pipeline and policy in that order, without gaps."""
    return F.array_compact(F.concat(*groups))


def label_map(sample: Column) -> Column:
    """Labels of a metric sample written as `name{key="value",...}`."""
    inner = F.regexp_extract(sample, r"\{(.*)\}", 1)
    pair = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
    names, values = (F.regexp_extract_all(inner, F.lit(pair), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(names, F.transform(values, lambda v: F.regexp_replace(v, r'\\(["\\])', "$1")))


def metric_name(sample: Column) -> Column:
    return F.regexp_extract(sample, r"^([^{\s]+)", 1)


def header_map(headers: Column) -> Column:
    """Message headers as a map of text; the last of repeated headers counts."""
    names = F.array_distinct(F.transform(headers, lambda h: h["key"]))
    return F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda n: F.element_at(
                F.filter(headers, lambda h: h["key"] == n), -1
            )["value"].cast("string"),
        ),
    )
