"""Exact percentiles of any number of rows, without holding the values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.plans.ordered import ROWS_PER_CHUNK, chunked, per_key, running


def exact_percentiles(
    rows: DataFrame,
    value: Column,
    shares: Sequence[float],
    keys: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per key one row with `rows` and columns `q0`, `q1`, ... for the shares, linearly interpolated."""
    grouped = (
        rows.select(*keys, value.cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .checkpoint()
    )
    chunks = chunked(grouped, [F.col("_v")], rows_per_chunk)
    counted = running(chunks, [F.col("_v")], {"_upto": ("sum", F.col("_n"))}, keys=keys)
    totals = grouped.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = per_key(counted, totals, keys)
    out = [F.max("_total").alias("rows")]
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_total") - 1).cast("double")
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v")))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v")))
        part = F.lit(float(share)) * (F.max("_total") - 1).cast("double")
        out.append((low + (high - low) * (part - F.floor(part))).alias(f"q{i}"))
    return joined.groupBy(*keys).agg(*out)
