"""Comparing two versions of the same rows: vectors, scores, actions and whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.plans.quantiles import exact_percentiles


def aligned(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of both sides by key, with columns `l_<name>` and `r_<name>`."""
    a = left.select(key, *[F.col(c).alias(f"l_{c}") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"r_{c}") for c in columns])
    return a.join(b, key)


def different(column: str) -> Column:
    """Null equals null; a null differs from every value."""
    return ~F.col(f"l_{column}").eqNullSafe(F.col(f"r_{column}"))


def any_difference(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for column in columns:
        out = out | different(column)
    return out


def differences_by_column(both: DataFrame, columns: Sequence[str], name: str = "column") -> DataFrame:
    """Number of differing rows per column, from one pass over the rows."""
    counts = both.agg(*[F.count_if(different(c)).alias(c) for c in columns])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias("different")) for c in columns]))
    )


def score_changes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Scores that changed, the largest change, and the median of the changes that are not zero."""
    gap = F.abs(F.col("l_score") - F.col("r_score"))
    both = aligned(left, right, key, ["score"]).select(gap.alias("d")).checkpoint()
    median = exact_percentiles(both.filter("d > 0"), F.col("d"), (0.5,)).select("q0").scalar()
    return both.agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("d") > 0).alias("changed"), F.max("d").alias("largest")
    ).withColumn("median_change", F.coalesce(median, F.lit(0.0)))


def transitions(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    both = aligned(left, right, key, [column])
    return both.groupBy(F.col(f"l_{column}").alias("expected"), F.col(f"r_{column}").alias("actual")).agg(
        F.count(F.lit(1)).alias("n")
    )


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of each side that the other does not have, as multisets."""
    extra = left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_left"))
    missing = right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_right"))
    return extra.withColumn("only_right", missing.scalar())
