"""Queries over scored rows: splits, folds, rankings, thresholds and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import DAY_US, query, r9, rounded
from tidegate.fixtures import load
from tidegate.functions.times import day_index, lit
from tidegate.operators import evaluate as ev
from tidegate.operators import fitting, splits

REVIEW, DECLINE, BUDGET = 0.55, 0.8, 0.01
_DAY0 = f"(SELECT min(event_us) - min(event_us) % {DAY_US} FROM scored)"
_CURVE = """SELECT *, sum(n) OVER w AS cum_n, sum(p) OVER w AS cum_p
            FROM (SELECT {keys} score, count(*) AS n, count(*) FILTER (WHERE {hit}) AS p FROM {rows} GROUP BY ALL) g
            WINDOW w AS ({part} ORDER BY score DESC)"""


def curve_sql(rows: str = "scored", keys: str = "", hit: str = "is_fraud") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return _CURVE.format(rows=rows, keys=keys + "," if keys else "", part=part, hit=hit)


def ap_sql(curve: str = "curve", keys: str = "") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {keys + ',' if keys else ''} CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positives,
        CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN
          round(sum(CAST(p AS DOUBLE) * CAST(cum_p AS DOUBLE) / CAST(cum_n AS DOUBLE)) / sum(p), 9) END AS average_precision,
        CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN
          round(sum(CAST(n - p AS DOUBLE) * (CAST(cum_p AS DOUBLE) - CAST(p AS DOUBLE) / 2)) / sum(p) / sum(n - p), 9) END AS roc_auc,
        round(CAST(sum(p) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS prevalence FROM {curve} {group}"""


def flags_sql(flag: str, prefix: str = "", scenarios: bool = False) -> str:
    out = f"""round(CAST(count(*) FILTER (WHERE {flag}) AS DOUBLE) / count(*), 9) AS {prefix}flagged_rate,
      round(CAST(count(*) FILTER (WHERE {flag} AND is_fraud) AS DOUBLE) / greatest(count(*) FILTER (WHERE {flag}), 1), 9) AS {prefix}precision,
      round(CAST(count(*) FILTER (WHERE {flag} AND is_fraud) AS DOUBLE) / greatest(count(*) FILTER (WHERE is_fraud), 1), 9) AS {prefix}recall,
      round(CAST(count(*) FILTER (WHERE {flag} AND NOT is_fraud) AS DOUBLE) / greatest(count(*) FILTER (WHERE NOT is_fraud), 1), 9) AS {prefix}false_positive_rate,
      round(CAST(coalesce(sum(amount_minor) FILTER (WHERE {flag} AND is_fraud), 0) AS DOUBLE)
            / greatest(coalesce(sum(amount_minor) FILTER (WHERE is_fraud), 0), 1), 9) AS {prefix}fraud_amount_captured"""
    if scenarios:
        for s in ev.SCENARIOS:
            out += f""", round(CAST(count(*) FILTER (WHERE {flag} AND fraud_{s}) AS DOUBLE)
                       / greatest(count(*) FILTER (WHERE fraud_{s}), 1), 9) AS {prefix}recall_{s}"""
    return out


_FLAG_NAMES = ["flagged_rate", "precision", "recall", "false_positive_rate", "fraud_amount_captured"]
_RANK_NAMES = ["average_precision", "roc_auc", "prevalence"]


def _r(df, *extra):
    names = {*_FLAG_NAMES, *_RANK_NAMES, *extra}
    floats = [f.name for f in df.schema if f.dataType.simpleString() == "double" and (f.name in names or True)]
    return rounded(df, *floats)


@query("met1_ranking", ap_sql(), ("scored",), {"curve": curve_sql()})
def met1(spark, folder):
    """MET-1, MET-2: average precision with ties grouped, ROC AUC and prevalence."""
    return _r(ev.average_precision(load(spark, folder, "scored")))


@query(
    "win2_precision_recall_curve",
    "SELECT score, n, p, CAST(cum_n AS BIGINT) AS cum_n, CAST(cum_p AS BIGINT) AS cum_p FROM curve",
    ("scored",),
    {"curve": curve_sql()},
)
def win2(spark, folder):
    """WIN-2, WIN-8: running hits and counts at every boundary between distinct scores."""
    return ev.curve(load(spark, folder, "scored"))


@query(
    "win3_deterministic_rank",
    "SELECT position, row_number() OVER (ORDER BY score DESC, decision_us, position) AS rank FROM scored",
    ("scored",),
)
def win3(spark, folder):
    """WIN-3: rank by score, ties by earlier decision, then position."""
    return ev.ranked(load(spark, folder, "scored"), ["decision_us", "position"]).select("position", "rank")


@query(
    "win4_stable_rank",
    "SELECT position, row_number() OVER (ORDER BY score DESC, position) AS rank FROM scored",
    ("scored",),
)
def win4(spark, folder):
    """WIN-4: rank by score, ties in input order."""
    return ev.ranked(load(spark, folder, "scored"), ["position"]).select("position", "rank")


_K = f"ceil(CAST({BUDGET} AS DOUBLE) * (SELECT count(*) FROM scored))"


# One row in thirteen has no score: it is kept, never flagged, and no row of the budget.
_SOME = "SELECT * REPLACE (CASE WHEN position % 13 = 0 THEN NULL ELSE score END AS score) FROM scored"
_K_SOME = f"ceil(CAST({BUDGET} AS DOUBLE) * (SELECT count(score) FROM partly))"


def _top_sql(order: str) -> dict[str, str]:
    place = f"row_number() OVER (ORDER BY score DESC NULLS LAST, {order})"
    return {"partly": _SOME, "flags": f"SELECT *, score IS NOT NULL AND {place} <= {_K_SOME} AS flagged FROM partly"}


def _some(spark, folder):
    score = F.when(F.col("position") % 13 != 0, F.col("score"))
    return load(spark, folder, "scored").withColumn("score", score)


@query("top1_review_budget", "SELECT position, score FROM flags WHERE flagged", ("scored",), _top_sql("position"))
def top1(spark, folder):
    """TOP-1: the ceil(budget * rows) highest scores, ties in input order."""
    return ev.with_top_k(_some(spark, folder), BUDGET, ["position"]).filter("flagged").select("position", "score")


@query("top2_budget_by_decision_time", "SELECT position, score FROM flags WHERE flagged", ("scored",), _top_sql("decision_us, position"))
def top2(spark, folder):
    """TOP-2: the same with ties by decision time."""
    rows = ev.with_top_k(_some(spark, folder), BUDGET, ["decision_us", "position"])
    return rows.filter("flagged").select("position", "score")


@query(
    "top3_kth_score",
    f"""SELECT (SELECT count(*) FROM scored) AS total, CAST({_K} AS BIGINT) AS k, min(score) AS threshold
        FROM (SELECT score FROM scored ORDER BY score DESC LIMIT (SELECT CAST({_K} AS BIGINT))) x""",
    ("scored",),
)
def top3(spark, folder):
    """TOP-3: the k-th highest score."""
    return ev.kth_score(ev.curve(load(spark, folder, "scored")), BUDGET).select("total", "k", "threshold")


@query("met3_flagged_metrics", f"SELECT {flags_sql(f'score >= CAST({REVIEW} AS DOUBLE)', scenarios=True)} FROM scored", ("scored",))
def met3(spark, folder):
    """MET-3, MET-4: rates, amounts and recall per scenario of a flag."""
    return _r(ev.flagged_metrics(load(spark, folder, "scored"), F.col("score") >= REVIEW, scenarios=ev.SCENARIOS))


@query("met5_budget_metrics", f"SELECT CAST({_K_SOME} AS BIGINT) AS reviewed, {flags_sql('flagged', scenarios=True)} FROM flags", ("scored",), _top_sql("position"))
def met5(spark, folder):
    """MET-5: the same metrics for the review budget."""
    rows = ev.with_top_k(_some(spark, folder), BUDGET, ["position"])
    out = rows.agg(F.count_if("flagged").alias("reviewed"), *ev.flagged_columns(F.col("flagged"), ev.SCENARIOS))
    return _r(out)


_CHOOSE = f"""SELECT max(t.threshold) AS review_threshold,
    min(c.score) FILTER (WHERE CAST(c.cum_p AS DOUBLE) / CAST(c.cum_n AS DOUBLE) >= CAST(0.9 AS DOUBLE) AND c.cum_n >= 20 AND c.score >= t.threshold)
      AS decline_threshold, max(t.k) AS k
    FROM curve c, (SELECT CAST({_K} AS BIGINT) AS k, min(score) AS threshold
                   FROM (SELECT score FROM scored ORDER BY score DESC LIMIT (SELECT CAST({_K} AS BIGINT))) x) t"""


@query("met6_choose_thresholds", _CHOOSE, ("scored",), {"curve": curve_sql()})
def met6(spark, folder):
    """MET-6: review threshold at the budget, lowest precise decline threshold."""
    return ev.choose_thresholds(load(spark, folder, "scored"), BUDGET, 0.9, 20)


_SCEN = {
    "long": " UNION ALL ".join(
        f"SELECT '{s}' AS scenario, score, fraud_{s} AS member, score >= CAST({REVIEW} AS DOUBLE) AS flag FROM scored WHERE fraud_{s} OR NOT is_fraud"
        for s in ev.SCENARIOS
    ),
    "curve": curve_sql("long", "scenario", "member"),
    "ap": ap_sql(keys="scenario"),
}


@query(
    "met7_scenario_metrics",
    """SELECT l.scenario, max(a.positives) AS positives, max(a.rows) AS population, max(a.average_precision) AS average_precision_vs_legit,
         round(CAST(count(*) FILTER (WHERE flag AND member) AS DOUBLE) / greatest(count(*) FILTER (WHERE member), 1), 9) AS recall_in_flagged,
         round(CAST(count(*) FILTER (WHERE flag AND member) AS DOUBLE) / greatest(count(*) FILTER (WHERE flag), 1), 9) AS precision_vs_legit_in_flagged
       FROM long l JOIN ap a ON a.scenario = l.scenario GROUP BY l.scenario""",
    ("scored",),
    _SCEN,
)
def met7(spark, folder):
    """MET-7: each scenario against the legitimate rows."""
    return _r(ev.scenario_metrics(load(spark, folder, "scored"), F.col("score") >= REVIEW))


_BINS = {
    "bins": """SELECT bin, count(*) AS n, sum(score) AS score_sum, count(*) FILTER (WHERE is_fraud) AS fraud,
                      sum((score - CAST(is_fraud AS DOUBLE)) * (score - CAST(is_fraud AS DOUBLE))) AS square_sum
               FROM (SELECT *, ntile(10) OVER (ORDER BY score, position) - 1 AS bin FROM scored) t GROUP BY bin"""
}


@query(
    "win5_equal_count_bins",
    "SELECT bin, n, round(score_sum / n, 9) AS mean_score, round(CAST(fraud AS DOUBLE) / n, 9) AS fraud_rate FROM bins",
    ("scored",),
    _BINS,
)
def win5(spark, folder):
    """WIN-5, MET-8: the reliability table over ten bins of equal size."""
    bins = ev.reliability(load(spark, folder, "scored"), "position")
    n = F.col("n").cast("double")
    return bins.select("bin", "n", r9(F.col("score_sum") / n, "mean_score"), r9(F.col("fraud").cast("double") / n, "fraud_rate"))


@query(
    "met8_calibration",
    """SELECT round(sum(square_sum) / sum(n), 9) AS brier, round(sum(abs(score_sum - fraud)) / sum(n), 9) AS ece,
              round(sum(score_sum) / sum(n), 9) AS mean_score, round(CAST(sum(fraud) AS DOUBLE) / sum(n), 9) AS fraud_rate FROM bins""",
    ("scored",),
    _BINS,
)
def met8(spark, folder):
    """MET-8: Brier score and expected calibration error."""
    return _r(ev.calibration(ev.reliability(load(spark, folder, "scored"), "position")))


_HALF = 1705276800000000  # 2024-01-15 00:00 UTC


@query(
    "met9_platt_calibration",
    f"""SELECT count(*) AS rows, round(avg(CAST(is_fraud AS INT)), 9) AS fraud_rate, TRUE AS mean_is_close, TRUE AS bins_are_close, TRUE AS fit_is_exact
        FROM scored WHERE decision_us >= {_HALF}""",
    ("scored",),
)
def met9(spark, folder):
    """MET-9: a calibrator fitted on the early part of the month and applied to the rest.

    Where it was fitted, its mean is the rate of fraud: that is the condition of the optimum."""
    rows = load(spark, folder, "scored").withColumn("score", F.least(F.col("score"), F.lit(1.0)))
    early, late = rows.filter(F.col("decision_us") < _HALF), rows.filter(F.col("decision_us") >= _HALF)
    platt = fitting.fit_platt(early)
    after = late.withColumn("score", platt.apply(F.col("score")))
    own = early.agg(F.abs(F.avg(platt.apply(F.col("score"))) - F.avg(F.col("is_fraud").cast("int"))).alias("off")).scalar()
    total = late.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = _r(ev.calibration(ev.reliability(after, "position")))
    return found.select(
        total.alias("rows"),
        "fraud_rate",
        (F.abs(F.col("mean_score") - F.col("fraud_rate")) < 0.02).alias("mean_is_close"),
        (F.col("ece") < 0.05).alias("bins_are_close"),
        (own < 1e-4).alias("fit_is_exact"),
    )


_F, _D = f"score >= CAST({REVIEW} AS DOUBLE)", f"score >= CAST({DECLINE} AS DOUBLE)"


@query(
    "met10_fixed_thresholds",
    f"""SELECT round(CAST(count(*) FILTER (WHERE {_F} AND NOT {_D}) AS DOUBLE) / count(*), 9) AS review_rate,
               round(CAST(count(*) FILTER (WHERE {_D}) AS DOUBLE) / count(*), 9) AS decline_rate,
               {flags_sql(_F, scenarios=True)}, {flags_sql(_D, 'decline_', scenarios=True)} FROM scored""",
    ("scored",),
)
def met10(spark, folder):
    """MET-10, MET-13: a fixed policy's rates and metrics."""
    return _r(ev.fixed_threshold_results(load(spark, folder, "scored"), REVIEW, DECLINE, scenarios=ev.SCENARIOS))


@query(
    "prj5_flagged_split",
    f"""SELECT count(*) FILTER (WHERE {_F}) AS flagged, count(*) FILTER (WHERE {_F} AND NOT is_fraud) AS legitimate_flagged,
          count(*) FILTER (WHERE {_F} AND NOT {_D}) AS reviewed, count(*) FILTER (WHERE {_D}) AS declined,
          count(*) FILTER (WHERE {_D} AND is_fraud) AS declined_fraud,
          count(*) FILTER (WHERE {_F} AND NOT {_D} AND NOT is_fraud) AS legitimate_reviewed,
          count(*) FILTER (WHERE {_D} AND NOT is_fraud) AS legitimate_declined,
          round(CAST(count(*) FILTER (WHERE {_F} AND NOT {_D}) AS DOUBLE) / count(*), 9) AS reviewed_rate,
          round(CAST(count(*) FILTER (WHERE {_D}) AS DOUBLE) / count(*), 9) AS declined_rate FROM scored""",
    ("scored",),
)
def prj5(spark, folder):
    """PRJ-5: flagged rows as reviewed or declined, fraudulent or legitimate."""
    return _r(ev.flagged_split(load(spark, folder, "scored"), REVIEW, DECLINE))


def week_sql(start: int, end: int, merge: bool = True) -> str:
    week = f"(decision_us - {_DAY0} - {start * DAY_US}) // {7 * DAY_US}"
    if merge:
        week = f"least({week}, {max((end - start) // 7 - 1, 0)})"
    return f"""SELECT *, CAST({start} + 7 * ({week}) AS BIGINT) AS week FROM scored
               WHERE decision_us >= {_DAY0} + {start * DAY_US} AND decision_us < {_DAY0} + {end * DAY_US}"""


_WEEKS = {"weeks": week_sql(2, 26), "curve": curve_sql("weeks", "week"), "ap": ap_sql(keys="week")}


def _weeks(spark, folder, start, end, merge=True):
    rows = load(spark, folder, "scored")
    week = splits.weekly(F.col("decision_us"), splits.first_day(rows), start, end, merge)
    return rows.withColumn("week", week).filter(F.col("week").isNotNull())


@query(
    "met11_window_metrics",
    f"""SELECT w.week, max(a.rows) AS rows, max(a.positives) AS positives, max(a.average_precision) AS average_precision,
          max(a.roc_auc) AS roc_auc, max(a.prevalence) AS prevalence, count(*) FILTER (WHERE {_F}) AS flagged,
          count(*) FILTER (WHERE {_F} AND NOT is_fraud) AS legitimate_flagged, {flags_sql(_F)}
        FROM weeks w JOIN ap a ON a.week = w.week GROUP BY w.week""",
    ("scored",),
    _WEEKS,
)
def met11(spark, folder):
    """MET-11, SPLIT-5: point metrics per week, a short tail merged into the last week."""
    return _r(ev.point_metrics(_weeks(spark, folder, 2, 26), F.col("score") >= REVIEW, ["week"]))


@query(
    "split5_weekly_windows",
    "SELECT week, count(*) AS rows, min(decision_us) AS first_us, max(decision_us) AS last_us FROM weeks GROUP BY week",
    ("scored",),
    {"weeks": week_sql(2, 26, merge=False)},
)
def split5(spark, folder):
    """SPLIT-5: weekly windows whose short tail stays on its own."""
    return _weeks(spark, folder, 2, 26, merge=False).groupBy("week").agg(
        F.count(F.lit(1)).alias("rows"), F.min("decision_us").alias("first_us"), F.max("decision_us").alias("last_us")
    )


@query(
    "met17_weekly_review_rate",
    f"SELECT week, count(*) AS rows, round(CAST(count(*) FILTER (WHERE {_F}) AS DOUBLE) / count(*), 9) AS review_rate FROM weeks GROUP BY week",
    ("scored",),
    {"weeks": week_sql(2, 26, merge=False)},
)
def met17(spark, folder):
    """MET-17: how a fixed threshold's review rate moves from week to week."""
    return _r(ev.review_rate(_weeks(spark, folder, 2, 26, merge=False), REVIEW, ["week"]))


_BOOT = {
    # Some rows have no score.
    "b": f"SELECT * REPLACE (CASE WHEN decision_us % 11 <> 0 THEN score END AS score), (decision_us - {_DAY0}) // {DAY_US} AS day FROM scored",
    "m": "SELECT CAST(r AS BIGINT) AS replicate, day, CAST((r * 31 + day * 17 + r * day) % 3 AS BIGINT) AS times FROM (SELECT DISTINCT day FROM b) d, range(20) t(r)",
    "g": f"""SELECT m.replicate, b.score, sum(m.times) AS n, sum(m.times) FILTER (WHERE is_fraud) AS p,
             sum(m.times) FILTER (WHERE {_F}) AS f, sum(m.times) FILTER (WHERE {_F} AND is_fraud) AS fp
             FROM b JOIN m ON b.day = m.day WHERE m.times > 0 GROUP BY 1, 2""",
    "c": """SELECT *, sum(n) OVER w AS cum_n, sum(coalesce(p, 0)) OVER w AS cum_p FROM g WINDOW w AS (PARTITION BY replicate ORDER BY score DESC)""",
    "reps": """SELECT replicate,
        sum(CAST(coalesce(p, 0) AS DOUBLE) * CAST(cum_p AS DOUBLE) / CAST(cum_n AS DOUBLE)) FILTER (WHERE score IS NOT NULL)
          / sum(coalesce(p, 0)) FILTER (WHERE score IS NOT NULL) AS average_precision,
        CAST(sum(coalesce(f, 0)) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS flagged_rate,
        CAST(sum(coalesce(fp, 0)) AS DOUBLE) / greatest(CAST(sum(coalesce(f, 0)) AS DOUBLE), 1) AS flagged_precision,
        CAST(sum(coalesce(fp, 0)) AS DOUBLE) / greatest(CAST(sum(coalesce(p, 0)) AS DOUBLE), 1) AS flagged_recall FROM c GROUP BY replicate""",
}
_BOOT_METRICS = ["average_precision", "flagged_rate", "flagged_precision", "flagged_recall"]


def _boot_rows(spark, folder):
    rows = load(spark, folder, "scored").withColumn("score", F.when(F.col("decision_us") % 11 != 0, F.col("score")))
    return rows.withColumn("day", day_index(F.col("decision_us"), splits.first_day(rows))).checkpoint()


@query(
    "met12_bootstrap_replicates",
    "SELECT replicate, " + ", ".join(f"round({m}, 9) AS {m}" for m in _BOOT_METRICS) + " FROM reps",
    ("scored",),
    _BOOT,
)
def met12(spark, folder):
    """MET-12: metrics per replicate for given day multiplicities."""
    rows = _boot_rows(spark, folder)
    r, d = F.col("replicate"), F.col("day")
    given = rows.select("day").distinct().withColumn("replicate", F.explode(F.sequence(lit(0), lit(19)))).withColumn(
        "times", (r * 31 + d * 17 + r * d) % 3
    )
    return _r(ev.bootstrap(rows, given, F.col("score") >= REVIEW))


@query(
    "met12_confidence_interval",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 9) AS low, round(quantile_cont({m}, 0.975), 9) AS high FROM reps" for m in _BOOT_METRICS),
    ("scored",),
    _BOOT,
)
def met12_interval(spark, folder):
    """MET-12: the central 95% of the replicates."""
    rows = _boot_rows(spark, folder)
    r, d = F.col("replicate"), F.col("day")
    given = rows.select("day").distinct().withColumn("replicate", F.explode(F.sequence(lit(0), lit(19)))).withColumn(
        "times", (r * 31 + d * 17 + r * d) % 3
    )
    return _r(ev.confidence_interval(ev.bootstrap(rows, given, F.col("score") >= REVIEW), _BOOT_METRICS))


_DRAWN = _BOOT | {
    "days": "SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT day FROM b) d",
    "m": """SELECT replicate, day, count(*) AS times FROM days JOIN (
              SELECT r AS replicate, CAST(concat('0x', substr(sha256(concat('0|', r, '|', k)), 1, 12)) AS BIGINT) % (SELECT max(total) FROM days) AS j
              FROM range(500) t(r), range((SELECT max(total) FROM days)) u(k)) x ON x.j = days.i GROUP BY 1, 2""",
}
_DRAWN = {name: _DRAWN[name] for name in ("b", "days", "m", "g", "c", "reps")}


@query(
    "met12_day_block_bootstrap",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 9) AS low, round(quantile_cont({m}, 0.975), 9) AS high FROM reps" for m in _BOOT_METRICS),
    ("scored",),
    _DRAWN,
)
def met12_drawn(spark, folder):
    """MET-12 with days drawn with replacement by a seeded hash, 500 replicates."""
    rows = _boot_rows(spark, folder)
    drawn = ev.day_draws(rows, 500)
    return _r(ev.confidence_interval(ev.bootstrap(rows, drawn, F.col("score") >= REVIEW), _BOOT_METRICS))


_TIMELINE = splits.Timeline(2, 14, 18, 26)


@query(
    "split2_masks",
    f"""SELECT split, count(*) AS n FROM (SELECT CASE
          WHEN decision_us >= d0 + {2 * DAY_US} AND decision_us < d0 + {14 * DAY_US} AND label_us <= d0 + {18 * DAY_US} THEN 'train'
          WHEN decision_us >= d0 + {2 * DAY_US} AND decision_us < d0 + {14 * DAY_US} THEN 'excluded'
          WHEN decision_us >= d0 + {18 * DAY_US} AND decision_us < d0 + {26 * DAY_US} THEN 'validation' END AS split
        FROM (SELECT *, {_DAY0} AS d0 FROM scored) s) t GROUP BY split""",
    ("scored",),
)
def split2(spark, folder):
    """SPLIT-2, PRED-1: train rows with a label known at the cutoff, the excluded ones, validation."""
    rows = load(spark, folder, "scored")
    return splits.split_rows(rows, _TIMELINE, splits.first_day(rows)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_FOLDS = splits.make_folds((14, 18, 22), burn_in=2, label_gap=4, calibration=4, evaluation=6, test_start=28)


def _folds_sql(rows: str = "scored") -> str:
    parts = []
    for f in _FOLDS:
        for part in ("fit", "cal", "eval"):
            a, b = getattr(f, part)
            parts.append(
                f"""SELECT s.*, '{f.name}' AS fold, '{part}' AS part, label_us <= {_DAY0} + {f.cutoff * DAY_US} AS known
                    FROM {rows} s WHERE decision_us >= {_DAY0} + {a * DAY_US} AND decision_us < {_DAY0} + {b * DAY_US}"""
            )
    return " UNION ALL ".join(parts)


@query(
    "split3_fold_rows",
    "SELECT position, fold, part, known FROM folds",
    ("scored",),
    {"folds": _folds_sql()},
)
def split3(spark, folder):
    """SPLIT-3: rows of each rolling fold; a row may be in several."""
    rows = load(spark, folder, "scored")
    return splits.assign_folds(rows, _FOLDS, splits.first_day(rows)).select("position", "fold", "part", "known")


@query(
    "split4_fold_counts",
    """SELECT fold, count(*) FILTER (WHERE part = 'fit' AND known) AS fit_rows, count(*) FILTER (WHERE part = 'fit' AND known AND is_fraud) AS fit_fraud,
         count(*) FILTER (WHERE part = 'fit' AND NOT known) AS fit_excluded_unlabelled, count(*) FILTER (WHERE part = 'cal' AND known) AS calibration_rows,
         count(*) FILTER (WHERE part = 'eval') AS eval_rows, count(*) FILTER (WHERE part = 'eval' AND is_fraud) AS eval_fraud FROM folds GROUP BY fold""",
    ("scored",),
    {"folds": _folds_sql()},
)
def split4(spark, folder):
    """SPLIT-4: counts per fold."""
    rows = load(spark, folder, "scored")
    return splits.fold_counts(splits.assign_folds(rows, _FOLDS, splits.first_day(rows)))


@query(
    "split6_elapsed_hours",
    f"""SELECT CASE WHEN h < 336 THEN 'train' WHEN h < 504 THEN 'validation' ELSE 'test' END AS split, count(*) AS n
        FROM (SELECT CAST(event_us - (SELECT min(event_us) FROM scored) AS DOUBLE) / 3600000000.0 AS h FROM scored) t GROUP BY 1""",
    ("scored",),
)
def split6(spark, folder):
    """SPLIT-6: windows in hours since the first event."""
    rows = load(spark, folder, "scored")
    first = rows.agg(F.min("event_us").alias("m")).scalar()
    hours = splits.elapsed_hours(F.col("event_us"), first)
    named = F.when(hours < 336, "train").when(hours < 504, "validation").otherwise("test")
    return rows.groupBy(named.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split7_stratified",
    """SELECT is_fraud, side, count(*) AS n FROM (SELECT is_fraud,
         CASE WHEN CAST(concat('0x', substr(sha256(concat(CASE WHEN is_fraud THEN 'true' ELSE 'false' END, '|', CAST(position AS VARCHAR))), 1, 8)) AS BIGINT) % 100 < 70
              THEN 'train' ELSE 'test' END AS side FROM scored) t GROUP BY ALL""",
    ("scored",),
)
def split7(spark, folder):
    """SPLIT-7: a 70/30 split within each class, by a hash of the key."""
    rows = splits.stratified_split(load(spark, folder, "scored"), "position", "is_fraud")
    return rows.groupBy("is_fraud", "side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj2_day_index",
    f"SELECT (decision_us - {_DAY0}) // {DAY_US} AS day, count(*) AS n FROM scored GROUP BY 1",
    ("scored",),
)
def prj2(spark, folder):
    """PRJ-2: day numbers from the midnight of the first event."""
    rows = load(spark, folder, "scored")
    return rows.groupBy(day_index(F.col("decision_us"), splits.first_day(rows)).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("pred2_before_test", f"SELECT count(*) AS n, max(decision_us) AS newest FROM scored WHERE decision_us < {_DAY0} + {26 * DAY_US}", ("scored",))
def pred2(spark, folder):
    """PRED-2: only rows received before the test period."""
    rows = load(spark, folder, "scored")
    kept = rows.filter(F.col("decision_us") < splits.first_day(rows) + lit(26 * DAY_US))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.max("decision_us").alias("newest"))


@query("pred3_holdout_guard", f"SELECT count(*) AS n FROM scored WHERE decision_us < {_DAY0} + {26 * DAY_US}", ("scored",))
def pred3(spark, folder):
    """PRED-3: the guarded plan reads to the end because the test rows were cut off before it."""
    rows = load(spark, folder, "scored")
    start = splits.first_day(rows) + lit(26 * DAY_US)
    return splits.guarded(rows.filter(F.col("decision_us") < start), start).agg(F.count("decision_us").alias("n"))


_MODEL_FOLDS = {
    "fold_rows": f"SELECT * FROM ({_folds_sql('models')}) x WHERE part = 'eval'",
    "curve": curve_sql("fold_rows", "family, config, fold"),
    "ap": ap_sql(keys="family, config, fold").replace("round(sum(CAST(p", "(sum(CAST(p").replace(") / sum(p), 9) END AS average_precision", ") / sum(p)) END AS average_precision"),
    "mean_ap": "SELECT family, config, avg(average_precision) AS mean_average_precision FROM ap GROUP BY family, config",
    "best": "SELECT family, config, mean_average_precision FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mean_average_precision DESC, config) AS r FROM mean_ap) t WHERE r = 1",
}


def _model_folds(spark, folder):
    scored = load(spark, folder, "scored")
    rows = splits.assign_folds(load(spark, folder, "models"), _FOLDS, splits.first_day(scored))
    return ev.mean_over_folds(rows.filter("part = 'eval'"))


@query("met14_mean_average_precision", "SELECT family, config, round(mean_average_precision, 9) AS mean_average_precision FROM mean_ap", ("scored", "models"), _MODEL_FOLDS)
def met14(spark, folder):
    """MET-14: mean average precision over the folds, per configuration."""
    return _r(_model_folds(spark, folder)[1])


@query("met14_best_per_family", "SELECT family, config, round(mean_average_precision, 9) AS mean_average_precision FROM best", ("scored", "models"), _MODEL_FOLDS)
def met14_best(spark, folder):
    """MET-14: the best configuration of each family."""
    return _r(ev.best_per_family(_model_folds(spark, folder)[1]))


@query(
    "met15_selection",
    """SELECT round(avg(c) - avg(i), 9) AS mean_gain, count(*) FILTER (WHERE c > i) AS fold_wins,
         CASE WHEN avg(c) - avg(i) >= 0.02 AND count(*) FILTER (WHERE c > i) >= 2 THEN 'trees' ELSE 'linear' END AS selected_family
       FROM (SELECT a.fold, max(average_precision) FILTER (WHERE a.family = 'trees') AS c, max(average_precision) FILTER (WHERE a.family = 'linear') AS i
             FROM ap a JOIN best b ON a.family = b.family AND a.config = b.config GROUP BY a.fold) t""",
    ("scored", "models"),
    _MODEL_FOLDS,
)
def met15(spark, folder):
    """MET-15: whether the challenger family replaces the incumbent."""
    per_fold, mean = _model_folds(spark, folder)
    return _r(ev.select_model(per_fold, ev.best_per_family(mean), "trees", "linear", 0.02, 2))


@query(
    "met16_acceptance",
    f"""SELECT max(average_precision) FILTER (WHERE config = 'depth=3') > max(average_precision) FILTER (WHERE config = 'C=1') AS ap_exceeds_baseline,
           bool_or(config = 'depth=3' AND rate BETWEEN 0.005 AND 0.2) AS review_rate_in_range,
           bool_or(config = 'depth=3' AND prec >= 0.2) AS precision_reached
        FROM (SELECT a.config, a.average_precision, x.rate, x.prec FROM ap a JOIN
              (SELECT config, CAST(count(*) FILTER (WHERE {_F}) AS DOUBLE) / count(*) AS rate,
                      CAST(count(*) FILTER (WHERE {_F} AND is_fraud) AS DOUBLE) / greatest(count(*) FILTER (WHERE {_F}), 1) AS prec
               FROM models GROUP BY config) x ON x.config = a.config) t""",
    ("models",),
    {"curve": curve_sql("models", "config"), "ap": ap_sql(keys="config")},
)
def met16(spark, folder):
    """MET-16: verdicts of a candidate against the baseline."""
    rows = load(spark, folder, "models").withColumnRenamed("config", "model")
    metrics = ev.point_metrics(rows.filter(F.col("model").isin("depth=3", "C=1")), F.col("score") >= REVIEW, ["model"])
    return ev.acceptance(metrics, "depth=3", "C=1", 0.005, 0.2, 0.2)


@query(
    "met18_score_parity",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE abs(a.score - b.score) > 0) AS changed, round(max(abs(a.score - b.score)), 9) AS max_abs_difference
       FROM (SELECT position, score FROM models WHERE config = 'depth=3') a JOIN (SELECT position, score FROM models WHERE config = 'depth=6') b
         ON a.position = b.position""",
    ("models",),
)
def met18(spark, folder):
    """MET-18: the largest difference between two scorings of the same rows."""
    rows = load(spark, folder, "models")
    return _r(ev.score_parity(rows.filter("config = 'depth=3'"), rows.filter("config = 'depth=6'"), "position"))


@query(
    "join6_label_as_of",
    f"""SELECT as_of_day, state, count(*) AS n FROM (SELECT d.as_of_day,
          CASE WHEN {_DAY0} + d.as_of_day * {DAY_US} < label_us THEN 'unknown' WHEN is_fraud THEN 'fraud' ELSE 'legit' END AS state
        FROM scored, (VALUES (CAST(10 AS BIGINT)), (CAST(20 AS BIGINT)), (CAST(30 AS BIGINT))) d(as_of_day)) t GROUP BY ALL""",
    ("scored",),
)
def join6(spark, folder):
    """JOIN-6: what was known about each outcome on three days; the days are part of the expression."""
    rows = load(spark, folder, "scored")
    day0 = splits.first_day(rows)
    states = F.array(
        *[
            F.struct(lit(d).alias("as_of_day"), splits.label_as_of(F.col("is_fraud"), F.col("label_us"), day0 + lit(d * DAY_US)).alias("state"))
            for d in (10, 20, 30)
        ]
    )
    return rows.select(F.inline(states)).groupBy("as_of_day", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg5_prevalence",
    """SELECT round(avg(CAST(is_fraud AS INT)), 9) AS fraud, round(avg(CAST(fraud_s1 AS INT)), 9) AS s1,
              round(avg(CAST(fraud_s2 AS INT)), 9) AS s2, round(avg(CAST(fraud_s3 AS INT)), 9) AS s3 FROM scored""",
    ("scored",),
)
def agg5(spark, folder):
    """AGG-5: shares of the boolean flags."""
    flags = {"fraud": "is_fraud", "s1": "fraud_s1", "s2": "fraud_s2", "s3": "fraud_s3"}
    return load(spark, folder, "scored").agg(*[r9(F.avg(F.col(c).cast("int")), n) for n, c in flags.items()])


@query("prj3_rule_score", "SELECT position, CAST(amount_minor AS DOUBLE) AS score FROM scored", ("scored",))
def prj3(spark, folder):
    """PRJ-3: a feature used as a score."""
    from tidegate.operators.scoring import rule_score

    return load(spark, folder, "scored").select("position", rule_score("amount_minor").alias("score"))


