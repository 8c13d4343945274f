"""Running aggregates and row numbers over one long order.

A window without partitions sends every row to one task, and a window over a hot key sends that
key to one task. Both are replaced by two levels: rows are cut into chunks along the order, the
window runs inside a chunk, and the totals of the earlier chunks are added from a table that has
one row per (key, chunk).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 2_000_000
MAX_CHUNKS = 4096  # of one cut; what is still too large is cut again
_STRIDE = 2 * MAX_CHUNKS + 4  # bucket numbers of one order column stay below this


@dataclass(frozen=True)
class Chunked:
    """A DataFrame with a chunk number that never decreases along its order."""

    df: DataFrame
    column: str
    single: bool  # every row is in chunk 0, so one window is enough


def _splits(df: DataFrame, column: str, parts: int) -> tuple[list[float], list[int]]:
    """Bucket bounds of about equal row counts, and the buckets that hold one heavy value."""
    probabilities = [i / parts for i in range(1, parts)]
    cuts = df.approxQuantile(column, probabilities, 1.0 / (4 * parts))
    bounds, heavy = [-math.inf], []
    for cut in sorted(set(cuts)):
        bounds.append(cut)
        if cuts.count(cut) > 1:
            heavy.append(len(bounds) - 1)
            bounds.append(math.nextafter(cut, math.inf))
    bounds.append(math.inf)
    merged = sorted(set(bounds))
    return merged, [merged.index(bounds[i]) for i in heavy]


def chunked(
    df: DataFrame,
    keys: Sequence[Column],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    column: str = "_chunk",
) -> Chunked:
    """Cut `df` along ascending numeric `keys`; a value heavier than a chunk is cut by the next key.

    Only the cut points reach the driver: at most MAX_CHUNKS numbers per key column. Where that many
    chunks are not enough, each is cut again until it fits, by cut points that stay in a table.
    """
    wanted = math.ceil(df.count() / rows_per_chunk)
    parts = min(wanted, MAX_CHUNKS)
    if parts <= 1:
        return Chunked(df.withColumn(column, F.lit(0).cast("decimal(38,0)")), column, True)
    out = df.withColumn(column, F.lit(0).cast("decimal(38,0)"))
    names, in_heavy = [], F.lit(True)
    for depth, key in enumerate(keys):
        name, bucket = f"{column}_k{depth}", f"{column}_b{depth}"
        names += [name, bucket]
        out = out.withColumn(name, key.cast("double"))
        bounds, heavy = _splits(out.filter(in_heavy), name, parts)
        out = Bucketizer(
            splits=bounds, inputCol=name, outputCol=bucket, handleInvalid="keep"
        ).transform(out)
        step = F.when(in_heavy, F.col(bucket).cast("decimal(10,0)")).otherwise(F.lit(0))
        out = out.withColumn(
            column, (F.col(column) * F.lit(_STRIDE) + step).cast("decimal(38,0)")
        )
        if not heavy:
            break
        in_heavy = in_heavy & F.col(bucket).isin([float(b) for b in heavy])
    out = out.drop(*names)
    if wanted > MAX_CHUNKS:
        out = _again(out, keys, rows_per_chunk, column)
    return Chunked(out, column, False)


def _again(df: DataFrame, keys: Sequence[Column], rows_per_chunk: int, column: str) -> DataFrame:
    """Cut chunks that are too large, by the first key that varies in them, until none is left.

    A row's new number counts the cut points below it and those up to it, so that a heavy value gets a
    chunk of its own, which the next round cuts by the next key.
    """
    values = [key.cast("double") for key in keys]
    while True:
        varies = [F.min(v) < F.max(v) for v in values]
        first = F.coalesce(*[F.when(v, F.lit(i + 1)) for i, v in enumerate(varies)])
        sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"), first.alias("_key"))
        large = sizes.filter((F.col("_n") > 2 * rows_per_chunk) & F.col("_key").isNotNull()).checkpoint()
        most = large.agg(F.max("_n")).first()[0]
        if most is None:
            return df
        parts = min(max(math.ceil(most / rows_per_chunk), 2), MAX_CHUNKS)
        value = F.element_at(F.array(*values), F.col("_key"))
        held = df.join(large.select(column, "_key"), column).select(column, value.alias("_v"))
        cuts = held.groupBy(column).agg(
            F.array_distinct(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 10 * parts)).alias("_cuts")
        )
        cuts = cuts.join(large.select(column, "_key"), column).checkpoint()
        place = F.size(F.filter("_cuts", lambda c: c < value)) + F.size(F.filter("_cuts", lambda c: c <= value))
        step = F.coalesce(F.when(F.col("_key").isNotNull(), place), F.lit(0))
        number = (F.col(column) * F.lit(_STRIDE) + step).cast("decimal(38,0)")
        df = df.join(cuts, column, "left").withColumn(column, number).drop("_cuts", "_key")


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    chunks: Chunked,
    order: Sequence[Column],
    values: dict[str, tuple[str, Column]],
    keys: Sequence[str] = (),
    inclusive: bool = True,
    peers: bool = False,
) -> DataFrame:
    """Add running sums, maxima or minima along `order`, per `keys`.

    `inclusive` counts the row itself; `peers` counts every row with the same (single) order value.
    """
    inside = Window.partitionBy(*keys, chunks.column).orderBy(*order)
    if peers:
        inside = inside.rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    else:
        inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = chunks.df.select(
        "*", *[_COMBINE[how](value).over(inside).alias(name) for name, (how, value) in values.items()]
    )
    if chunks.single:
        return local
    before = Window.partitionBy(*keys).orderBy(chunks.column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunks.df.groupBy(*keys, chunks.column)
        .agg(*[_COMBINE[how](value).alias(f"_t_{name}") for name, (how, value) in values.items()])
        .select(
            *keys,
            chunks.column,
            *[
                _COMBINE[how](f"_t_{name}").over(before).alias(f"_o_{name}")
                for name, (how, _) in values.items()
            ],
        )
    )
    joined = local.join(offsets, [*keys, chunks.column], "left")
    for name, (how, _) in values.items():
        offset = F.col(f"_o_{name}")
        if how == "sum":
            both = F.when(
                F.col(name).isNull() & offset.isNull(), F.lit(None)
            ).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.coalesce(offset, F.lit(0)))
        elif how == "max":
            both = F.greatest(F.col(name), offset)
        else:
            both = F.least(F.col(name), offset)
        joined = joined.withColumn(name, both).drop(f"_o_{name}")
    return joined


def last_before(
    chunks: Chunked, order: Sequence[str], keys: Sequence[str], when: Column, value: Column, name: str, small: bool = False
) -> DataFrame:
    """The newest earlier row of the same key for which `when` holds, as struct `name`.

    `small` says that no key has more rows than a chunk; then they need not be cut."""
    inside = (
        Window.partitionBy(*keys, *([] if small else [chunks.column]))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    picked = F.when(when, value)
    local = chunks.df.withColumn(name, F.last(picked, ignorenulls=True).over(inside))
    if chunks.single or small:
        return local
    before = Window.partitionBy(*keys).orderBy(chunks.column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunks.df.filter(when)
        .groupBy(*keys, chunks.column)
        .agg(F.max_by(value, F.struct(*order)).alias("_newest"))
    )
    # A chunk without such a row still needs the value carried from the chunks before it.
    carried = (
        chunks.df.select(*keys, chunks.column)
        .distinct()
        .join(offsets, [*keys, chunks.column], "left")
        .select(
            *keys,
            chunks.column,
            F.last("_newest", ignorenulls=True).over(before).alias("_carried"),
        )
    )
    return (
        local.join(carried, [*keys, chunks.column], "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_carried")))
        .drop("_carried")
    )


def per_key(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of a table that has one row per key, or one row where there are no keys."""
    if keys:
        return rows.join(table, list(keys))
    only = table.select(F.struct("*")).scalar()
    return rows.withColumn("_only", only).select("*", *[F.col(f"_only.{c}").alias(c) for c in table.columns]).drop("_only")


def row_numbers(
    df: DataFrame,
    keys: Sequence[Column],
    ties: Sequence[Column | str] = (),
    name: str = "rank",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """1-based position in the order of the ascending numeric `keys`, then `ties`."""
    chunks = chunked(df, keys, rows_per_chunk)
    numbered = running(chunks, [*keys, *ties], {name: ("sum", F.lit(1).cast("bigint"))})
    return numbered.drop(chunks.column)


def framed(df: DataFrame, keys: Sequence[str], at: str, width: int) -> DataFrame:
    """Cut the time of each key into slices of `width`, and copy each row into the next slice.

    A frame that reaches back at most `width` is then complete inside (key, `_slice`), and only rows
    with `_own` are results. No slice holds more than two widths of a key.
    """
    here = F.floor(F.col(at) / F.lit(width)).cast("bigint")
    places = F.array(
        F.struct(here.alias("_slice"), F.lit(True).alias("_own")),
        F.struct((here + 1).alias("_slice"), F.lit(False).alias("_own")),
    )
    return df.select("*", F.inline(places))
