"""Ranking, budget, threshold and calibration metrics over scored rows.

Scores are grouped before they are ordered, and the order is cut into chunks, so no metric sends all
rows to one task and none collects scores. `keys` compute a metric per model, fold or window at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.scalars import ratio
from tidegate.functions.times import lit
from tidegate.plans.ordered import ROWS_PER_CHUNK, chunked, per_key, row_numbers, running

SCENARIOS = ("s1", "s2", "s3")


def curve(
    rows: DataFrame,
    keys: Sequence[str] = (),
    positive: Column | None = None,
    score: str = "score",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    weight: Column | None = None,
) -> DataFrame:
    """Per distinct score, highest first: rows `n`, positives `p`, and their running sums.

    Rows without a score are not part of a curve: they have no place in it and don't count as rows.
    """
    hit = F.col("is_fraud") if positive is None else positive
    each = lit(1) if weight is None else weight
    grouped = (
        rows.filter(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.sum(each).alias("n"), F.sum(F.when(hit, each).otherwise(lit(0))).alias("p"))
        .checkpoint()
    )
    chunks = chunked(grouped, [-F.col("score")], rows_per_chunk)
    return running(
        chunks,
        [F.col("score").desc()],
        {"cum_n": ("sum", F.col("n")), "cum_p": ("sum", F.col("p"))},
        keys=keys,
    ).drop(chunks.column)


def ranking(curved: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision (null when there is one class), ROC AUC and prevalence of a curve."""
    n, p = F.col("n"), F.col("p")
    step = p.cast("double") * F.col("cum_p").cast("double") / F.col("cum_n").cast("double")
    # A pair (positive, negative) is ordered right if the positive scores higher; ties count half.
    right = (n - p).cast("double") * (F.col("cum_p").cast("double") - p.cast("double") / 2)
    total_p, total_n = F.sum("p"), F.sum("n")
    both = (total_p > 0) & (total_p < total_n)
    return curved.groupBy(*keys).agg(
        total_n.alias("rows"),
        total_p.alias("positives"),
        F.when(both, F.sum(step) / total_p.cast("double")).alias("average_precision"),
        F.when(both, F.sum(right) / total_p.cast("double") / (total_n - total_p).cast("double")).alias("roc_auc"),
        (total_p.cast("double") / total_n.cast("double")).alias("prevalence"),
    )


def average_precision(rows: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    return ranking(curve(rows, keys, **options), keys)


def budget_size(budget: float, total: Column) -> Column:
    """ceil(budget * rows) in double arithmetic."""
    return F.ceil(F.lit(float(budget)) * total.cast("double")).cast("bigint")


def kth_score(curved: DataFrame, budget: float, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: k, the k-th highest score, and how many rows score higher than it."""
    totals = curved.groupBy(*keys).agg(F.max("cum_n").alias("total"))
    sized = totals.withColumn("k", F.greatest(budget_size(budget, F.col("total")), lit(1)))
    joined = per_key(curved, sized, keys)
    reached = joined.filter(F.col("cum_n") >= F.col("k"))
    return reached.groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.max("k").alias("k"),
        F.max("score").alias("threshold"),
        F.max_by(F.col("cum_n") - F.col("n"), "score").alias("higher"),
    )


def choose_thresholds(
    rows: DataFrame,
    budget: float,
    min_precision: float,
    min_count: int,
    keys: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Review threshold at the budget, and the lowest decline threshold that is precise enough.

    Only boundaries between distinct scores are cut points, which the grouped curve gives by itself.
    """
    curved = curve(rows, keys, **options)
    review = kth_score(curved, budget, keys)
    precise = F.col("cum_p").cast("double") / F.col("cum_n").cast("double") >= F.lit(float(min_precision))
    enough = F.col("cum_n") >= min_count
    above = F.col("score") >= F.col("threshold")
    joined = per_key(curved, review, keys)
    return joined.groupBy(*keys).agg(
        F.max("threshold").alias("review_threshold"),
        F.min(F.when(precise & enough & above, F.col("score"))).alias("decline_threshold"),
        F.max("k").alias("k"),
    )


def with_top_k(
    rows: DataFrame,
    budget: float,
    ties: Sequence[str],
    name: str = "flagged",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Flag the ceil(budget * rows) highest scores; equal scores go by the ascending `ties`.

    Rows without a score are kept, are never flagged and don't count as rows of the budget.
    Only the rows that share the score at the cut are ordered; the others are compared with it.
    """
    cut = kth_score(curve(rows, rows_per_chunk=rows_per_chunk), budget).first()
    if cut is None or cut["total"] is None:
        return rows.withColumn(name, F.lit(False))
    needed = math.ceil(budget * cut["total"]) - cut["higher"]
    at_cut = F.col("score").eqNullSafe(F.lit(cut["threshold"]))
    others = rows.filter(~at_cut).withColumn(name, F.coalesce(F.col("score") > F.lit(cut["threshold"]), F.lit(False)))
    ranked = row_numbers(
        rows.filter(at_cut), [F.col(c) for c in ties], name="_rank", rows_per_chunk=rows_per_chunk
    )
    tied = ranked.withColumn(name, F.col("_rank") <= needed).drop("_rank")
    return others.unionByName(tied)


def ranked(rows: DataFrame, ties: Sequence[str], name: str = "rank", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Position by score descending, then the ascending `ties`."""
    return row_numbers(rows, [-F.col("score"), *[F.col(c) for c in ties]], name=name, rows_per_chunk=rows_per_chunk)


def flagged_columns(flag: Column, scenarios: Sequence[str] = (), prefix: str = "") -> list[Column]:
    """Rates and captured amounts of a flag, as aggregates over any grouping."""
    fraud = F.col("is_fraud")
    tp, flagged = F.count_if(flag & fraud), F.count_if(flag)
    out = [
        (flagged.cast("double") / F.count(F.lit(1)).cast("double")).alias(f"{prefix}flagged_rate"),
        ratio(tp, flagged).alias(f"{prefix}precision"),
        ratio(tp, F.count_if(fraud)).alias(f"{prefix}recall"),
        ratio(F.count_if(flag & ~fraud), F.count_if(~fraud)).alias(f"{prefix}false_positive_rate"),
        ratio(
            F.coalesce(F.sum(F.when(flag & fraud, F.col("amount_minor"))), lit(0)),
            F.coalesce(F.sum(F.when(fraud, F.col("amount_minor"))), lit(0)),
        ).alias(f"{prefix}fraud_amount_captured"),
    ]
    for name in scenarios:
        member = F.col(f"fraud_{name}")
        out.append(ratio(F.count_if(flag & member), F.count_if(member)).alias(f"{prefix}recall_{name}"))
    return out


def flagged_metrics(
    rows: DataFrame, flag: Column, keys: Sequence[str] = (), scenarios: Sequence[str] = ()
) -> DataFrame:
    return rows.groupBy(*keys).agg(*flagged_columns(flag, scenarios))


def scenario_metrics(rows: DataFrame, flag: Column, **options) -> DataFrame:
    """Each scenario's fraud against all legitimate rows; a row counts in each of its scenarios.

    Rows are first summed per score and membership, so the copies per scenario are copies of sums.
    """
    members = [f"fraud_{s}" for s in SCENARIOS]
    summed = rows.groupBy("score", "is_fraud", *members, flag.alias("_flag")).agg(
        F.count(F.lit(1)).alias("_w")
    )
    places = [
        F.when(F.col(f"fraud_{s}") | ~F.col("is_fraud"), F.struct(F.lit(s).alias("scenario"), F.col(f"fraud_{s}").alias("member")))
        for s in SCENARIOS
    ]
    long = summed.select(
        "score", "_flag", "_w", F.inline(F.array_compact(F.array(*places)))
    )
    weight, member = F.col("_w"), F.col("member")
    ap = ranking(curve(long, ["scenario"], member, weight=weight, **options), ["scenario"])
    counts = long.groupBy("scenario").agg(
        F.sum(F.when(member & F.col("_flag"), weight).otherwise(lit(0))).alias("_fp"),
        F.sum(F.when(F.col("_flag"), weight).otherwise(lit(0))).alias("_fl"),
    )
    return ap.join(counts, "scenario").select(
        "scenario",
        "positives",
        F.col("rows").alias("population"),
        F.col("average_precision").alias("average_precision_vs_legit"),
        ratio(F.col("_fp"), F.col("positives")).alias("recall_in_flagged"),
        ratio(F.col("_fp"), F.col("_fl")).alias("precision_vs_legit_in_flagged"),
    )


def reliability(
    rows: DataFrame, position: str, bins: int = 10, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Equal-count bins by ascending score; larger bins come first, as an even split gives them."""
    ranks = row_numbers(rows, [F.col("score"), F.col(position)], name="_rank", rows_per_chunk=rows_per_chunk)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    at, size = F.col("_rank") - 1, F.floor(total / bins).cast("bigint")
    extra = F.pmod(total, lit(bins))
    large = extra * (size + 1)
    number = F.when(at < large, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - large) / F.greatest(size, lit(1))))
    return (
        ranks.withColumn("bin", number.cast("bigint"))
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("score").alias("score_sum"),
            F.count_if(F.col("is_fraud")).alias("fraud"),
            F.sum(F.pow(F.col("score") - F.col("is_fraud").cast("double"), F.lit(2.0))).alias("square_sum"),
        )
    )


def calibration(bins: DataFrame) -> DataFrame:
    """Brier score and expected calibration error from the bins of `reliability`."""
    n = F.sum("n").cast("double")
    gap = F.abs(F.col("score_sum") - F.col("fraud").cast("double"))
    return bins.agg(
        (F.sum("square_sum") / n).alias("brier"),
        (F.sum(gap) / n).alias("ece"),
        (F.sum("score_sum") / n).alias("mean_score"),
        (F.sum("fraud").cast("double") / n).alias("fraud_rate"),
    )


def policy_flags(score: Column, review: float, decline: float | None) -> tuple[Column, Column]:
    """Flagged (review or decline) and declined, for one fixed policy."""
    declined = F.lit(False) if decline is None else score >= F.lit(float(decline))
    return score >= F.lit(float(review)), declined


def fixed_threshold_results(
    rows: DataFrame, review: float, decline: float | None, keys: Sequence[str] = (), scenarios: Sequence[str] = ()
) -> DataFrame:
    flagged, declined = policy_flags(F.col("score"), review, decline)
    total = F.count(F.lit(1)).cast("double")
    columns = [
        (F.count_if(flagged & ~declined).cast("double") / total).alias("review_rate"),
        (F.count_if(declined).cast("double") / total).alias("decline_rate"),
        *flagged_columns(flagged, scenarios),
    ]
    if decline is not None:
        columns += flagged_columns(declined, scenarios, "decline_")
    return rows.groupBy(*keys).agg(*columns)


def flagged_split(rows: DataFrame, review: float, decline: float | None, keys: Sequence[str] = ()) -> DataFrame:
    """Flagged rows as reviewed and declined, fraudulent and legitimate."""
    flagged, declined = policy_flags(F.col("score"), review, decline)
    reviewed, fraud = flagged & ~declined, F.col("is_fraud")
    total = F.count(F.lit(1)).cast("double")
    return rows.groupBy(*keys).agg(
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & ~fraud).alias("legitimate_flagged"),
        F.count_if(reviewed).alias("reviewed"),
        F.count_if(declined).alias("declined"),
        F.count_if(declined & fraud).alias("declined_fraud"),
        F.count_if(reviewed & ~fraud).alias("legitimate_reviewed"),
        F.count_if(declined & ~fraud).alias("legitimate_declined"),
        (F.count_if(reviewed).cast("double") / total).alias("reviewed_rate"),
        (F.count_if(declined).cast("double") / total).alias("declined_rate"),
    )


def point_metrics(rows: DataFrame, flag: Column, keys: Sequence[str], **options) -> DataFrame:
    """Ranking and flag metrics per key, for models or reporting windows."""
    ap = ranking(curve(rows, keys, **options), keys)
    fraud = F.col("is_fraud")
    flags = rows.groupBy(*keys).agg(
        F.count_if(flag).alias("flagged"),
        F.count_if(flag & ~fraud).alias("legitimate_flagged"),
        *flagged_columns(flag),
    )
    return ap.join(flags, list(keys))


def bootstrap(
    rows: DataFrame,
    multiplicities: DataFrame,
    flag: Column,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    per_block: int = 256,
) -> DataFrame:
    """Metrics of each replicate when whole days are drawn with replacement.

    `multiplicities` has (replicate, day, times). Rows need `day`, `score`, `is_fraud`. The rows are
    summed per (score, day) once; a chunk of that order is multiplied with the draws of `per_block`
    replicates inside a task, starting from the day totals of the chunks before it. The draws stay in a
    table with one row per block and day, so neither replicates nor days are limited; rows are copied
    per block and not per replicate. Rows without a score take no part in the ranking, as in `curve`, and count
    in the other metrics.
    """
    summed = multiplicities.groupBy("replicate", "day").agg(F.sum("times").alias("times"))
    blocks = summed.select("replicate", "day", "times", F.pmod(F.xxhash64("replicate"), F.lit(0x7FFFFFFF)).alias("h")).checkpoint()
    count = blocks.select(F.count_distinct("replicate")).first()[0]
    numbers = max(1, math.ceil(count / per_block))
    blocks = blocks.withColumn("block", F.pmod(F.col("h").cast("bigint"), lit(numbers)))
    draws = blocks.groupBy("block", "day").agg(F.collect_list(F.struct("replicate", "times")).alias("draws")).checkpoint()

    tallies = (
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_fraud")).alias("p"),
        F.count_if(flag).alias("f"),
        F.count_if(flag & F.col("is_fraud")).alias("fp"),
    )
    placed = F.col("score").isNotNull()
    cells = rows.filter(placed).groupBy("score", "day").agg(*tallies).checkpoint()
    drawn = [F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "p", "f", "fp")]
    scoreless = rows.filter(~placed).groupBy("day").agg(*tallies).join(summed, "day").groupBy("replicate").agg(*drawn)
    chunks = chunked(cells, [-F.col("score")], rows_per_chunk)
    per_day = chunks.df.groupBy(chunks.column, "day").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    before = Window.partitionBy("day").orderBy(chunks.column).rowsBetween(Window.unboundedPreceding, 0)
    # One row per chunk and drawn day: as many as the clock and the chunks have, not the rows.
    all_days = draws.agg(F.collect_set("day").alias("days")).scalar()
    grid = (
        chunks.df.select(chunks.column).distinct().withColumn("day", F.explode(all_days))
        .join(per_day, [chunks.column, "day"], "left")
        .select(
            chunks.column,
            "day",
            (F.sum(F.coalesce("n", lit(0))).over(before) - F.coalesce("n", lit(0))).alias("n"),
            (F.sum(F.coalesce("p", lit(0))).over(before) - F.coalesce("p", lit(0))).alias("p"),
        )
        .withColumn("kind", lit(0))
    )
    places = chunks.df.select(chunks.column).distinct().withColumn("day", F.explode(all_days))
    drawn_rows = places.join(draws, "day").withColumn("kind", lit(2))
    both = chunks.df.withColumn("kind", lit(1)).unionByName(grid, allowMissingColumns=True)
    both = both.withColumn("block", F.explode(F.sequence(lit(0), lit(numbers - 1))))
    both = both.unionByName(drawn_rows, allowMissingColumns=True)

    def partial(part: pa.Table) -> pa.Table:
        pdf = part.to_pandas()
        drawn_days = pdf[pdf["kind"] == 2]
        replicates = sorted({d["replicate"] for draws in drawn_days["draws"] for d in draws})
        place_r, place_d = {r: i for i, r in enumerate(replicates)}, {d: i for i, d in enumerate(sorted(set(pdf["day"])))}
        times = np.zeros((len(place_d), len(replicates)), np.int64)
        for day, draws in zip(drawn_days["day"], drawn_days["draws"], strict=True):
            for d in draws:
                times[place_d[day], place_r[d["replicate"]]] = d["times"]
        start = pdf[pdf["kind"] == 0]
        body = pdf[pdf["kind"] == 1].sort_values("score", ascending=False)
        score = body["score"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        day0 = [place_d[d] for d in start["day"]]
        day = [place_d[d] for d in body["day"]]
        n0, p0 = start["n"].to_numpy(np.int64), start["p"].to_numpy(np.int64)
        counts = {c: body[c].to_numpy(np.int64) for c in ("n", "p", "f", "fp")}
        out = {c: [] for c in ("gained", "n", "p", "f", "fp")}
        for block in np.array_split(np.arange(len(replicates)), max(math.ceil(score.size * len(replicates) / 4_000_000), 1)):
            drawn, drawn0 = times[day][:, block], times[day0][:, block]
            n = np.add.reduceat(counts["n"][:, None] * drawn, first, 0)
            p = np.add.reduceat(counts["p"][:, None] * drawn, first, 0)
            cum_n, cum_p = n0 @ drawn0 + np.cumsum(n, 0), p0 @ drawn0 + np.cumsum(p, 0)
            out["gained"].append((p * (cum_p / np.maximum(cum_n, 1))).sum(0))
            out["n"].append(n.sum(0))
            out["p"].append(p.sum(0))
            out["f"].append(counts["f"] @ drawn)
            out["fp"].append(counts["fp"] @ drawn)
        joined = {c: np.concatenate(v) for c, v in out.items()}
        return pa.table({"replicate": pa.array(replicates, pa.int64()), **joined})

    schema = "replicate bigint, gained double, n bigint, p bigint, f bigint, fp bigint"
    ranked = both.groupBy(chunks.column, "block").applyInArrow(partial, schema)
    parts = ranked.withColumns({"ranked_n": F.col("n"), "ranked_p": F.col("p")}).unionByName(scoreless, allowMissingColumns=True)
    p, n, f, fp = F.sum("p"), F.sum("n"), F.sum("f"), F.sum("fp")
    hits, places = F.coalesce(F.sum("ranked_p"), lit(0)), F.coalesce(F.sum("ranked_n"), lit(0))
    return parts.groupBy("replicate").agg(
        F.when((hits > 0) & (hits < places), F.sum("gained") / hits.cast("double")).otherwise(F.lit(0.0)).alias("average_precision"),
        (f.cast("double") / n.cast("double")).alias("flagged_rate"),
        ratio(fp, f).alias("flagged_precision"),
        ratio(fp, p).alias("flagged_recall"),
    )


def confidence_interval(replicates: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Central 95% of each metric over the replicates, with linear interpolation."""
    long = replicates.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))
    return long.groupBy("metric").agg(
        F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high")
    )


def day_draws(days: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """How often each day is drawn in each replicate; slices of a hash replace a sequential generator."""
    numbered = days.select("day").distinct().withColumn(
        "i", F.row_number().over(Window.orderBy("day")) - 1
    )
    total = days.select(F.count_distinct("day").alias("n")).scalar()
    draws = (
        days.sparkSession.range(replicates)
        .withColumnRenamed("id", "replicate")
        .withColumn("draw", F.explode(F.sequence(lit(0), total - 1)))
        .withColumn("h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "replicate", "draw"), 256))
        .withColumn("i", F.pmod(F.conv(F.substring("h", 1, 12), 16, 10).cast("bigint"), total))
    )
    drawn = draws.groupBy("replicate", "i").agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(numbered, "i").select("replicate", "day", "times")


def mean_over_folds(scored: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Average precision per (family, config, fold), and its mean per configuration."""
    keys = ["family", "config", "fold"]
    per_fold = ranking(curve(scored, keys, **options), keys).select(*keys, "average_precision")
    mean = per_fold.groupBy("family", "config").agg(F.avg("average_precision").alias("mean_average_precision"))
    return per_fold, mean


def best_per_family(mean: DataFrame) -> DataFrame:
    """The configuration with the highest mean; equal means go to the first name."""
    rank = Window.partitionBy("family").orderBy(F.desc("mean_average_precision"), "config")
    best = mean.withColumn("_r", F.row_number().over(rank)).filter("_r = 1")
    return best.select("family", "config", "mean_average_precision")


def select_model(
    per_fold: DataFrame, best: DataFrame, challenger: str, incumbent: str, min_gain: float, min_wins: int, within_limits: bool = True
) -> DataFrame:
    """Whether the challenger family replaces the incumbent: mean gain, fold wins and limits."""
    chosen = per_fold.join(best.select("family", "config"), ["family", "config"])
    sides = chosen.groupBy("fold").agg(
        F.max(F.when(F.col("family") == challenger, F.col("average_precision"))).alias("c"),
        F.max(F.when(F.col("family") == incumbent, F.col("average_precision"))).alias("i"),
    )
    verdict = sides.agg((F.avg("c") - F.avg("i")).alias("mean_gain"), F.count_if(F.col("c") > F.col("i")).alias("fold_wins"))
    takes = (F.col("mean_gain") >= min_gain) & (F.col("fold_wins") >= min_wins) & F.lit(within_limits)
    return verdict.withColumn(
        "selected_family", F.when(F.coalesce(takes, F.lit(False)), F.lit(challenger)).otherwise(F.lit(incumbent))
    )


def acceptance(metrics: DataFrame, candidate: str, baseline: str, low: float, high: float, min_precision: float) -> DataFrame:
    """Verdicts of a candidate against a baseline, from one row of point metrics per model."""

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    return metrics.agg(
        (of(candidate, "average_precision") > of(baseline, "average_precision")).alias("ap_exceeds_baseline"),
        of(candidate, "flagged_rate").between(low, high).alias("review_rate_in_range"),
        (of(candidate, "precision") >= min_precision).alias("precision_reached"),
    )


def review_rate(rows: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """Share of rows at or above a fixed threshold, per window."""
    hit = F.col("score") >= F.lit(float(threshold))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(hit).cast("double") / F.count(F.lit(1)).cast("double")).alias("review_rate"),
    )


def score_parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows compared, rows that differ and the largest difference of two scorings."""
    both = left.select(key, F.col("score").alias("a")).join(right.select(key, F.col("score").alias("b")), key)
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(gap > 0).alias("changed"), F.max(gap).alias("max_abs_difference")
    )
