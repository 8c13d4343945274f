"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import written
from tidegate.llm.keyed import matched

WEIGHTS = (5, 2, 1)
#: Documents, and then residuals, that one step of the tree rounds together.
FAN = 512
SPACES = r"[\x20\x09-\x0D]"


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    bare = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), f"^{SPACES}+|{SPACES}+\\z", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"{SPACES}+"))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, place, source_size, source_rows, target) from rows (source, size).

    Sources by code point, null last, weigh `weights`, repeating, and share the total of all sizes by weight.
    A target stops at `most` times its source's size; the excess is shared by weight among the others until
    none is above. In the order of size over weight that is one running sum: the common share per weight is
    the first (and so the largest) one that its own source does not fall below. The windows see one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    total = F.sum("source_size").over(Window.partitionBy())
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("share", (total - filled) / open_weight)
    level = F.max(F.when(F.col("share") <= F.col("cap") / F.col("weight"), F.col("share"))).over(Window.partitionBy())
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return per.select("source", "place", "source_size", "source_rows", target.alias("target"))


def draw(seed: int, *names) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, names)), seed) / 2.0**64


def pivot(names: list, sizes: list, parts: list, seed: int) -> int | None:
    """Round parts (0 to 1) in place; the index of the one that stays fractional, if any. Sizes fall.

    Two sides trade mass along the line that keeps their words' sum, up or down at random so that each part
    keeps its mean, until one side is 0 or 1. While all parts are equal, the largest open document trades
    with all smaller ones as one side, if they have mass and room enough; it is settled first, so that a long
    document isn't what stays open. The others trade two by two; who stays open goes on to the next."""
    rest, share, at = sum(s for s in sizes if s > 0), parts[0] if len(set(parts)) == 1 else None, 0
    while share is not None and at < len(parts) - 1 and sizes[at] > 0 and 0.0 < share < 1.0:
        rest -= sizes[at]
        if min(share * rest - sizes[at] * (1 - share), (1 - share) * rest - sizes[at] * share) < 0:
            break
        up = draw(seed, "side", names[at]) < share
        parts[at], share = float(up), min(1.0, max(0.0, share + (sizes[at] / rest) * (share - 1 if up else share)))
        at += 1
    if share is not None:
        parts[at:] = [share] * (len(parts) - at)
    held = None
    for i, (size, part) in enumerate(zip(sizes, parts)):
        if size <= 0:
            parts[i] = 0.0
            continue
        if part <= 0.0 or part >= 1.0:
            continue
        if held is None:
            held = i
            continue
        a, b, p, q = sizes[held], size, parts[held], part
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        if draw(seed, names[held], names[i]) * (up + down) < down:
            p, q = (1.0, q - up / b) if a * (1 - p) <= b * q else (p + up / a, 0.0)
        else:
            p, q = (0.0, q + down / b) if a * p <= b * (1 - q) else (p - down / a, 1.0)
        parts[held], parts[i] = p, q
        if 1e-12 < q < 1 - 1e-12:
            if not 1e-12 < p < 1 - 1e-12:
                parts[held], held = float(round(p)), i
        else:
            parts[i] = float(round(q))
            if not 1e-12 < p < 1 - 1e-12:
                parts[held], held = float(round(p)), None
    return held


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, most: float = 3.0, seed: int = 42, fan: int = FAN) -> DataFrame:
    """One row per document: key, size (words), source_size, target (of its source), copies.

    copies is 0 to `most`. A source's documents share one fraction of copies, target over size; its whole part
    is given to all, the rest is rounded: groups of about `fan` documents of a source are rounded by pivoting,
    each leaves at most one fractional document, and those are rounded in turn until one is left, which goes
    to the nearer side. The words that a source takes so differ from its target by half a document at most;
    all other documents keep their mean. Groups and draws come from hashes of the key: reruns agree. Rows of a
    key that repeats, or of no key, are dealt by their place as well, so they don't fall into one group.

    Null texts have size 0 and take no copies; a null source is a source, the last one; rows that repeat a key
    are rounded one by one; equal sizes are ordered by key; an empty table gives no rows."""
    kind = docs.schema[key].dataType.simpleString()
    sized = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    rows = written(sized.withColumns({"_row": F.monotonically_increasing_id(), "_name": F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit(""))}), "sizes")
    again = written(rows.groupBy("_name").agg(F.count("*").alias("_again")).where("_again > 1"), "again")
    rows = matched(rows, again, ["_name"], "_again", "left") if not again.isEmpty() else rows.withColumn("_again", F.lit(1))
    per = written(targets(rows.select("source", "size"), weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = rows.join(per.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    groups = F.greatest(F.ceil(F.col("source_rows") / fan), F.lit(1))
    dealt = F.when(F.col("_again") > 1, F.xxhash64(F.lit(seed), "key", "_row")).otherwise(F.xxhash64(F.lit(seed), "key"))
    placed = placed.select(F.col("key").cast("string").alias("key"), "size", "place", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("part"), F.pmod(dealt, groups).alias("bucket"))
    spread = max(1, math.ceil((per.agg(F.max("source_rows")).first()[0] or 0) / fan))
    shape = "key string, size bigint, place int, whole bigint, part double, bucket bigint, open boolean"

    def level(frame: DataFrame, last: bool) -> DataFrame:
        def settle(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "key"], ascending=[False, True]).reset_index(drop=True)
            parts = group["part"].tolist()
            names = group["key"].tolist()
            left = pivot(names, group["size"].tolist(), parts, seed)
            if left is not None and last:
                parts[left] = float(parts[left] >= 0.5)
                left = None
            return group.assign(part=parts, open=[i == left for i in range(len(parts))])

        return written(frame.groupBy("place", "bucket").applyInPandas(settle, shape), "rounded")

    done, step = None, placed
    while True:
        last = spread == 1
        step = level(step, last)
        settled = step.where("not open")
        done = settled if done is None else done.union(settled)
        if last:
            break
        step = step.where("open").withColumn("bucket", F.expr(f"bucket div {fan}")).drop("open")
        spread = math.ceil(spread / fan)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("part").cast("long")).otherwise(0).alias("copies")
    out = done.join(per.select("place", "source_size", "target"), "place")
    return out.select(F.col("key").cast(kind).alias(key), "size", "source_size", "target", copies)


def taken(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows that the mix takes, each repeated by its copies, with the same columns.

    Rows are told apart by key and text; rows that repeat both are one with the sum of their copies."""
    marks = [F.xxhash64(F.lit(i), F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("string") for i in (1, 2)]
    marked = docs.withColumn("_mark", F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("null")), *marks))
    copies = mixed(marked, "_mark", source, text, **how).groupBy("_mark").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    copies = written(copies, "copies")
    chosen = marked.join(copies.where("_copies > 0"), "_mark")
    once = chosen.where("_rows = 1")
    if not copies.where("_rows > 1").isEmpty():
        once = once.union(chosen.where("_rows > 1").dropDuplicates(["_mark"]))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(docs.columns)
