"""Chronological splits, folds and reporting windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.times import DAY, HOUR, lit


def first_day(events: DataFrame, event_us: str = "event_us") -> Column:
    """Midnight of the day of the first event, as a scalar subquery."""
    low = F.min(event_us)
    return events.agg((low - F.pmod(low, lit(DAY))).alias("day0")).scalar()


def in_days(us: Column, day0: Column, start: float, end: float) -> Column:
    """Half-open window [start, end) in days."""
    return (us >= day0 + lit(int(start * DAY))) & (us < day0 + lit(int(end * DAY)))


def label_as_of(is_fraud: Column, label_us: Column, as_of_us: Column) -> Column:
    return (
        F.when(as_of_us < label_us, F.lit("unknown"))
        .when(is_fraud, F.lit("fraud"))
        .otherwise(F.lit("legit"))
    )


@dataclass(frozen=True)
class Timeline:
    """Day numbers of a train / validation / test layout."""

    burn_in: int
    train_end: int
    cutoff: int
    test_start: int

    def __post_init__(self) -> None:
        if not 0 <= self.burn_in < self.train_end <= self.cutoff < self.test_start:
            raise ValueError("days must satisfy burn_in < train_end <= cutoff < test_start")


def split_rows(rows: DataFrame, timeline: Timeline, day0: Column) -> DataFrame:
    """Add `split`: train, excluded (label unknown at the cutoff), validation, or null."""
    decided = F.col("decision_us")
    candidate = in_days(decided, day0, timeline.burn_in, timeline.train_end)
    labelled = F.col("label_us") <= day0 + lit(timeline.cutoff * DAY)
    return rows.withColumn(
        "split",
        F.when(candidate & labelled, F.lit("train"))
        .when(candidate, F.lit("excluded"))
        .when(in_days(decided, day0, timeline.cutoff, timeline.test_start), F.lit("validation")),
    )


class HoldoutTouched(ValueError):
    """Rows of the final test period reached code that must not see them."""


def require_before_test(rows: DataFrame, test_start_us: int) -> DataFrame:
    if not rows.filter(F.col("decision_us") >= test_start_us).isEmpty():
        raise HoldoutTouched("rows of the final test period must not reach training")
    return rows


def guarded(rows: DataFrame, test_start: Column) -> DataFrame:
    """The same guard inside the plan: the job fails on the first such row."""
    message = F.lit("rows of the final test period must not reach training")
    checked = F.when(F.col("decision_us") >= test_start, F.raise_error(message).cast("bigint"))
    return rows.withColumn("decision_us", F.coalesce(checked, F.col("decision_us")))


@dataclass(frozen=True)
class Fold:
    name: str
    cutoff: int
    fit: tuple[int, int]
    cal: tuple[int, int]
    eval: tuple[int, int]


def make_folds(
    cutoffs: Sequence[int], burn_in: int, label_gap: int, calibration: int, evaluation: int, test_start: int
) -> list[Fold]:
    folds = []
    for cutoff in cutoffs:
        end = cutoff - label_gap
        start = end - calibration
        fold = Fold(f"cutoff{cutoff:03d}", cutoff, (burn_in, start), (start, end), (cutoff, cutoff + evaluation))
        if fold.eval[1] > test_start or fold.fit[1] <= fold.fit[0]:
            raise ValueError(f"invalid fold {fold.name}")
        folds.append(fold)
    return folds


def assign_folds(rows: DataFrame, folds: Sequence[Fold], day0: Column) -> DataFrame:
    """One row per (row, fold, part); a row may serve in several folds. `known` says that its label
    was available at the fold's cutoff. The few folds are part of the expression, so nothing is joined.
    """
    decided = F.col("decision_us")
    places = []
    for fold in folds:
        known = F.col("label_us") <= day0 + lit(fold.cutoff * DAY)
        for part in ("fit", "cal", "eval"):
            here = F.struct(F.lit(fold.name).alias("fold"), F.lit(part).alias("part"), known.alias("known"))
            places.append(F.when(in_days(decided, day0, *getattr(fold, part)), here))
    exploded = rows.withColumn("_place", F.explode(F.array_compact(F.array(*places))))
    return exploded.select(*rows.columns, "_place.*")


def fold_counts(assigned: DataFrame) -> DataFrame:
    """Row and fraud counts per fold."""
    fit, known = F.col("part") == "fit", F.col("known")
    cal, evaluation = F.col("part") == "cal", F.col("part") == "eval"
    fraud = F.col("is_fraud")
    return assigned.groupBy("fold").agg(
        F.count_if(fit & known).alias("fit_rows"),
        F.count_if(fit & known & fraud).alias("fit_fraud"),
        F.count_if(fit & ~known).alias("fit_excluded_unlabelled"),
        F.count_if(cal & known).alias("calibration_rows"),
        F.count_if(evaluation).alias("eval_rows"),
        F.count_if(evaluation & fraud).alias("eval_fraud"),
    )


def weekly(us: Column, day0: Column, start: int, end: int, merge_tail: bool = True) -> Column:
    """First day of the seven-day window of [start, end) that holds `us`; null outside.

    With `merge_tail` a last window shorter than seven days belongs to the one before it.
    """
    week = F.floor((us - day0 - lit(start * DAY)) / lit(7 * DAY)).cast("bigint")
    if merge_tail:
        week = F.least(week, lit(max((end - start) // 7 - 1, 0)))
    return F.when(in_days(us, day0, start, end), lit(start) + week * 7)


def elapsed_hours(us: Column, start_us: Column) -> Column:
    return (us - start_us).cast("double") / F.lit(float(HOUR))


def stratified_split(rows: DataFrame, key: str, stratum: str, train_percent: int = 70) -> DataFrame:
    """Add `side` from a hash of the key, so that it is the same on every run and in every class."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(stratum).cast("string"), F.col(key).cast("string")), 256), 1, 8), 16, 10)
    share = F.pmod(digest.cast("bigint"), lit(100))
    return rows.withColumn("side", F.when(share < train_percent, F.lit("train")).otherwise(F.lit("test")))


def split_at_cutoff(rows: DataFrame, cutoff: Column, delay_us: int = 0) -> DataFrame:
    """Add `bootstrap` (available before the cutoff) and `scoring` (decided at or after it)."""
    return rows.withColumns(
        {
            "bootstrap": F.col("received_us") + lit(delay_us) < cutoff,
            "scoring": F.col("received_us") >= cutoff,
        }
    )
