"""Rates and latency bounds from scraped counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.scalars import label_map, metric_name
from tidegate.functions.times import US
from tidegate.plans.ordered import framed

WINDOW_US = 60 * US


def samples(pages: DataFrame, text: str = "text") -> DataFrame:
    """Scraped pages as (scrape_us, sample, value); comments and lines without a number are left out."""
    lines = F.filter(F.split(text, "\n"), lambda line: (line != "") & ~line.startswith("#"))
    parts = pages.select("scrape_us", F.explode(lines).alias("_line"))
    value = F.regexp_extract("_line", r"\s(\S+)$", 1).try_cast("double")
    return parts.select(
        "scrape_us", F.regexp_extract("_line", r"^(.*)\s\S+$", 1).alias("sample"), value.alias("value")
    ).filter("value IS NOT NULL")


def parsed(scrapes: DataFrame) -> DataFrame:
    """Samples `name{labels}` with their name and label map."""
    return scrapes.withColumns({"name": metric_name(F.col("sample")), "labels": label_map(F.col("sample"))})


def deltas(scrapes: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Each sample against the oldest one inside the window: `delta` and the seconds between them.

    A sample that the older scrape did not have counts from zero.
    """
    times = scrapes.select("scrape_us").distinct()
    back = Window.partitionBy("_slice").orderBy("scrape_us").rangeBetween(-window_us, 0)
    pairs = (
        framed(times, [], "scrape_us", window_us)
        .withColumn("old_us", F.min("scrape_us").over(back))
        .filter("_own AND old_us < scrape_us")
        .select("scrape_us", "old_us")
    )
    old = scrapes.select(F.col("scrape_us").alias("old_us"), "sample", F.col("value").alias("old_value"))
    return (
        scrapes.join(pairs, "scrape_us")
        .join(old, ["old_us", "sample"], "left")
        .withColumn("delta", F.col("value") - F.coalesce("old_value", F.lit(0.0)))
        .withColumn("seconds", (F.col("scrape_us") - F.col("old_us")).cast("double") / US)
    )


def rates(changes: DataFrame, counter: str) -> DataFrame:
    """Requests, requests per second and error rate per scrape; a restart gives no row."""
    rows = parsed(changes).filter(F.col("name") == counter)
    status = F.element_at("labels", "status")
    totals = rows.groupBy("scrape_us").agg(
        F.sum("delta").alias("requests"),
        F.sum(F.when(~status.startswith("2"), F.col("delta")).otherwise(0.0)).alias("errors"),
        F.max("seconds").alias("seconds"),
        F.min("delta").alias("_least"),
    )
    kept = totals.filter("_least >= 0 AND requests >= 0")
    return kept.select(
        "scrape_us",
        F.col("requests").cast("bigint").alias("requests"),
        F.round(F.col("requests") / F.col("seconds"), 2).alias("per_second"),
        F.col("errors").cast("bigint").alias("errors"),
        F.when(F.col("requests") > 0, F.round(F.col("errors") / F.col("requests"), 4)).alias("error_rate"),
    )


def histogram_bound(cells: DataFrame, share: float, keys: Sequence[str]) -> DataFrame:
    """Smallest bucket bound that holds `share` of the observations; null beyond the last bound.

    `cells` has (keys, le, cumulative), with infinity for the last bucket.
    """
    total = cells.groupBy(*keys).agg(F.max("cumulative").alias("_total"))
    reached = cells.join(total, list(keys)).filter(
        (F.col("_total") > 0) & (F.col("cumulative") >= F.lit(float(share)) * F.col("_total"))
    )
    bound = F.min("le")
    return reached.groupBy(*keys).agg(F.when(bound < float("inf"), bound).alias("bound"))


def bucket_cells(changes: DataFrame, histogram: str, keys: Sequence[str], **labels: str) -> DataFrame:
    """Bucket counters of one histogram as (keys, le, cumulative)."""
    rows = parsed(changes).filter(F.col("name") == histogram)
    for label, value in labels.items():
        rows = rows.filter(F.element_at("labels", label) == value)
    le = F.element_at("labels", "le")
    bound = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.cast("double"))
    return rows.select(*keys, bound.alias("le"), F.col("delta").alias("cumulative"))
