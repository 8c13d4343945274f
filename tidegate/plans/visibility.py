"""Exact aggregates over history that is visible in two times at once.

A query (x, y) of one entity asks for all points of that entity with event time `u < x` that had
arrived, `v <= y`. Pairing queries with points grows with the square of a hot entity, so:

* Ordinary entities are dealt to tasks, which read them one after another and answer a bounded number
  of rows at once by sorts and binary searches. Only points that arrive after some later decision need
  more than a prefix.
* An entity larger than a unit is cut into chunks along both times. A query is then the sum of
  (a) points in its own event-time chunk, (b) points of earlier event-time chunks in its own
  arrival chunk, and (c) whole cells (earlier event-time chunk, earlier arrival chunk), which are
  aggregated before they are read. Each part is again a set of bounded units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_UNIT = 500_000
ROWS_AT_ONCE = 50_000  # rows of whole entities that a task answers together; a larger entity is answered alone
ASKED_AT_ONCE = 500_000  # questions that are answered together: one slot at a time for the largest entities; rows of a grid unit
MAX_CUTS = 2048
MAX_LISTED = 1_000_000  # numbers that may be broadcast: hot entities, or their cut points
NOTHING = -(2**63)


@dataclass(frozen=True)
class Scan:
    """One set of questions per row: visible points of `keys` before each offset of the event time.

    `offsets` maps a slot name to the microseconds subtracted from the row's event time, a number
    or a column of the row. `sums` names the slots that also need the summed weight, `last` those
    that need the newest visible event time. `until` maps slots to the column up to which they see
    arrivals; the others see those up to the row's decision.
    """

    prefix: str
    keys: tuple[str, ...]
    offsets: tuple[tuple[str, int | str], ...]
    sums: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    until: tuple[tuple[str, str], ...] = ()

    def columns(self) -> list[str]:
        names = [f"{self.prefix}_n_{slot}" for slot, _ in self.offsets]
        names += [f"{self.prefix}_s_{slot}" for slot in self.sums]
        return names + [f"{self.prefix}_last_{slot}" for slot in self.last]


def count_visible(pg, pu, pv, weights, pm, qg, qx, qy):
    """For each query: summed `weights` rows and newest `pm` over points with u < x and v <= y.

    All arguments are int64 arrays; groups are small non-negative codes. Points that some later
    query cannot see yet are counted by halving the order, one sort per halving.
    """
    n, q = pu.size, qx.size
    if n == 0 or q == 0:
        return np.zeros((weights.shape[0], q), np.int64), np.full(q, NOTHING, np.int64)
    order = np.lexsort((pm, pu, pg))
    pg, pu, pv, pm, weights = pg[order], pu[order], pv[order], pm[order], weights[:, order]
    ku, kx = _with_group(pg, pu, qg, np.clip(qx, pu.min(), pu.max() + 1))
    kv, ky = _with_group(pg, pv, qg, np.clip(qy, pv.min() - 1, pv.max()))
    pos = np.searchsorted(ku, kx, "left")
    base = np.searchsorted(pg, qg, "left")
    sums = np.concatenate([np.zeros((weights.shape[0], 1), np.int64), np.cumsum(weights, 1)], 1)
    total = sums[:, pos] - sums[:, base]
    last = pos - 1
    newest_arrival = np.maximum.accumulate(kv)
    dirty = (pos > base) & (newest_arrival[np.maximum(pos - 1, 0)] > ky)
    if dirty.any():
        at, y = pos[dirty], ky[dirty]
        earliest = np.full(n + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, at, y)
        pending = kv > np.minimum.accumulate(earliest[::-1])[::-1][1:]
        clean = np.maximum.accumulate(np.where(pending, -1, np.arange(n)))
        late = np.flatnonzero(pending)
        missing, seen = _pending(kv[late], weights[:, late], late, np.searchsorted(late, at), y)
        total[:, dirty] -= missing
        last[dirty] = np.maximum(clean[at - 1], seen)
    newest = np.where((pos > base) & (last >= base), pm[np.maximum(last, 0)], NOTHING)
    return total, newest


def _with_group(pg, pa, qg, qa):
    """Order-preserving int64 keys for (group, value), shared by points and queries."""
    low, high = int(min(pa.min(), qa.min())), int(max(pa.max(), qa.max()))
    groups = int(max(pg.max(), qg.max())) + 1
    if groups * (high - low + 2) >= 2**62:
        values = np.unique(np.concatenate([pa, qa]))
        pa, qa = np.searchsorted(values, pa), np.searchsorted(values, qa)
        low, high = 0, values.size - 1
    span = high - low + 2
    return pg * span + (pa - low + 1), qg * span + (qa - low + 1)


def _pending(kv, weights, index, before, y):
    """Weights above `y` and newest index at or below `y`, among the first `before` late points."""
    m = kv.size
    rank = np.empty(m, np.int64)
    rank[np.argsort(kv, kind="stable")] = np.arange(m)
    cut = np.searchsorted(np.sort(kv), y, "right")
    above = np.zeros((weights.shape[0], y.size), np.int64)
    newest = np.full(y.size, -1, np.int64)
    for bit in range(int(m).bit_length()):
        use = np.flatnonzero((before >> bit) & 1)
        if use.size == 0:
            continue
        keys = (np.arange(m) >> bit) * m + rank
        inner = np.argsort(keys)
        keys = keys[inner]
        sums = np.concatenate(
            [np.zeros((weights.shape[0], 1), np.int64), np.cumsum(weights[:, inner], 1)], 1
        )
        block = (before[use] >> bit) - 1
        split = np.searchsorted(keys, block * m + cut[use], "left")
        start, stop = block << bit, (block + 1) << bit
        above[:, use] += sums[:, stop] - sums[:, split]
        highest = np.maximum.accumulate(index[inner])
        found = np.where(split > start, highest[np.maximum(split - 1, 0)], -1)
        newest[use] = np.maximum(newest[use], found)
    return above, newest


def _codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Small group codes of the key columns."""
    codes = np.zeros(table.num_rows, np.int64)
    for key in keys:
        part = pc.dictionary_encode(table[key].combine_chunks(), null_encoding="encode")
        codes = codes * max(len(part.dictionary), 1) + part.indices.to_numpy(zero_copy_only=False)
    return np.unique(codes, return_inverse=True)[1] if len(keys) > 1 else codes


def _ints(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy().astype(np.int64, copy=False)


def _or_null(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NOTHING)


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole entities from rows that come entity by entity: no more are held than `most` rows, the rest of
    an entity and a batch."""
    held, count = [], 0
    for batch in batches:
        if count >= most and batch.num_rows:
            entity = batch.column(batch.num_columns - 1).to_numpy()
            before = held[-1].column(batch.num_columns - 1)[-1].as_py()
            starts = np.flatnonzero(np.concatenate([[entity[0] != before], entity[1:] != entity[:-1]]))
            if starts.size:
                yield pa.Table.from_batches([*held, batch.slice(0, starts[0])])
                held, count, batch = [], 0, batch.slice(starts[0])
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _unit(scans: Sequence[Scan], columns: list[str], most: int):
    """The function applied to the rows of a task, whole entities one after another."""

    def answer(table: pa.Table) -> pa.Table:
        point = table["_point"].to_numpy().astype(bool)
        t, seen_at = _ints(table, "_u"), _ints(table, "_y")
        u, v = t[point], _ints(table, "_v")[point]
        one, amount = np.ones((1, u.size), np.int64), _ints(table, "_w")[point][None]
        out = table
        for scan in scans:
            g, until, answers = _codes(table, scan.keys), dict(scan.until), {}
            weights = np.concatenate([one, amount]) if scan.sums else one
            step = max(1, ASKED_AT_ONCE // t.size)
            for start in range(0, len(scan.offsets), step):
                some = scan.offsets[start : start + step]
                x = np.concatenate([t - (_ints(table, back) if isinstance(back, str) else back) for _, back in some])
                y = np.concatenate([_ints(table, until[slot]) if slot in until else seen_at for slot, _ in some])
                total, newest = count_visible(g[point], u, v, weights, u, np.tile(g, len(some)), x, y)
                for i, (slot, _) in enumerate(some):
                    rows = slice(i * t.size, (i + 1) * t.size)
                    answers[f"{scan.prefix}_n_{slot}"] = pa.array(total[0, rows].copy())
                    if slot in scan.sums:
                        answers[f"{scan.prefix}_s_{slot}"] = pa.array(total[1, rows].copy())
                    if slot in scan.last:
                        answers[f"{scan.prefix}_last_{slot}"] = _or_null(newest[rows])
            for name in scan.columns():
                out = out.append_column(name, answers[name])
        return out.select(columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, most):
            answered = answer(table).to_batches(max_chunksize=10_000)
            del table
            yield from answered
            # Nothing of an entity is held while the next one is read.
            del answered
            pa.default_memory_pool().release_unused()

    return each


@dataclass(frozen=True)
class Hot:
    """The entities with more rows than one unit; there are at most rows / rows_per_unit of them."""

    frame: DataFrame | None = None  # key columns, written once
    entities: int = 0
    largest: int = 0
    rows: int = 0


def oversized(df: DataFrame, keys: Sequence[str], rows: int, rows_per_unit: int) -> Hot:
    if rows <= rows_per_unit:
        return Hot()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = counts.filter(F.col("_rows") > rows_per_unit).checkpoint()
    found = large.agg(F.count(F.lit(1)).alias("n"), F.max("_rows").alias("m"), F.sum("_rows").alias("s")).first()
    return Hot(large.select(*keys), found["n"], found["m"], found["s"]) if found["n"] else Hot()


def visible(
    df: DataFrame,
    scans: Sequence[Scan],
    event_us: str,
    available_us: Column,
    decision_us: str,
    weight: str,
    is_point: Column,
    row_id: str,
    rows: int,
    hot: Hot,
    rows_per_unit: int = ROWS_PER_UNIT,
) -> DataFrame:
    """Answer `scans` for every row of `df`; the keys of later scans must contain those of the first.

    `row_id` must identify a row. `rows` and `hot` (from `oversized`, for the first scan's keys) size
    the units; they come from the caller so that an expensive `df` is not computed to measure it.
    """
    first = scans[0]
    base = df.select(
        "*",
        F.col(event_us).alias("_u"),
        available_us.alias("_v"),
        F.col(decision_us).alias("_y"),
        F.col(weight).alias("_w"),
        is_point.alias("_point"),
    )
    if not hot.entities:
        return _pack(base, df.columns, scans, rows, rows_per_unit)
    large, cold = _split(base, first.keys, hot)
    # Read by every part of the grid, so it is written once.
    large = large.checkpoint()
    answered = _by_grid(large, first, hot, row_id, rows_per_unit)
    for scan in scans[1:]:
        inner = large.select(*df.columns)
        nested = visible(
            inner,
            [scan],
            event_us,
            available_us,
            decision_us,
            weight,
            is_point,
            row_id,
            hot.rows,
            oversized(inner, scan.keys, hot.rows, rows_per_unit),
            rows_per_unit,
        )
        answered = answered.join(nested.select(row_id, *scan.columns()), row_id)
    names = [*df.columns, *[c for s in scans for c in s.columns()]]
    packed = _pack(cold, df.columns, scans, rows, rows_per_unit)
    return packed.select(*names).unionByName(answered.select(*names))


def _split(base: DataFrame, keys: Sequence[str], hot: Hot) -> tuple[DataFrame, DataFrame]:
    """Rows of the listed entities, and the others."""
    listed = hot.frame.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(keys)})
    if hot.entities <= MAX_LISTED:
        listed = F.broadcast(listed)
    on = F.lit(True)
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"_h{i}"))
    return base.join(listed, on, "left_semi"), base.join(listed, on, "left_anti")


def _pack(
    base: DataFrame, kept: Sequence[str], scans: Sequence[Scan], rows: int, rows_per_unit: int
) -> DataFrame:
    """Whole entities, hashed to tasks that read them in the order of their hash."""
    workers = base.sparkSession.sparkContext.defaultParallelism
    units = max(math.ceil(rows / rows_per_unit), min(2 * workers, math.ceil(rows / 2000)), 1)
    base = base.withColumn("_entity", F.xxhash64(*scans[0].keys))
    base = base.repartition(units, "_entity").sortWithinPartitions("_entity")
    columns = [*kept, *[c for s in scans for c in s.columns()]]
    schema = T.StructType(
        [base.schema[c] for c in kept]
        + [T.StructField(c, T.LongType(), True) for s in scans for c in s.columns()]
    )
    return base.mapInArrow(_unit(scans, columns, min(rows_per_unit, ROWS_AT_ONCE)), schema)


def _chunk_of(value: Column, cuts: Column) -> Column:
    """How many of the sorted `cuts` are at or below `value`, looking at one block of 64."""
    firsts = F.filter(cuts, lambda c, i: i % 64 == 0)
    block = F.greatest(F.size(F.filter(firsts, lambda c: c <= value)) - 1, F.lit(0))
    inside = F.slice(cuts, block * 64 + 1, F.lit(64))
    return (block * 64 + F.size(F.filter(inside, lambda c: c <= value))).cast("bigint")


def _back(offset: int | str) -> Column:
    return F.col(offset) if isinstance(offset, str) else F.lit(offset).cast("bigint")


def _cuts(values: str, shares: list[float]) -> list[Column]:
    """Cut points of about equal counts, and the values heavy enough to be cut off on their own."""
    raw = F.percentile_approx(values, shares, 10 * len(shares))
    heavy = F.filter(raw, lambda c, i: (i > 0) & (F.get(raw, i - 1) == c))
    single = F.array_distinct(heavy)
    cuts = F.array_sort(
        F.array_distinct(F.concat(raw, F.transform(single, lambda c: c + F.lit(1).cast("bigint"))))
    )
    return [cuts, single]


def _grid_unit(keys: Sequence[str], kept: Sequence[str]):
    """The function applied to one grid unit: rows with `_kind` 0 are points, others are queries."""

    def answer(table: pa.Table) -> pa.Table:
        point = table["_kind"].to_numpy() == 0
        points, asked = table.filter(pa.array(point)), table.filter(pa.array(~point))
        total, newest = count_visible(
            np.zeros(points.num_rows, np.int64),
            _ints(points, "_a"),
            _ints(points, "_b"),
            np.stack([_ints(points, "_n"), _ints(points, "_s")]),
            _ints(points, "_m"),
            np.zeros(asked.num_rows, np.int64),
            _ints(asked, "_a"),
            _ints(asked, "_b"),
        )
        out = asked.select([*keys, *kept])
        for name, values in (("_n", pa.array(total[0])), ("_s", pa.array(total[1]))):
            out = out.append_column(name, values)
        return out.append_column("_m", _or_null(newest))

    return answer


def _answered(points: DataFrame, queries: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Answer each query from the points of its unit, named by `keys`."""
    schema = T.StructType(
        [queries.schema[c] for c in [*keys, *kept]]
        + [T.StructField(c, T.LongType()) for c in ("_n", "_s", "_m")]
    )
    # unionByName fills the columns of the other side with nulls.
    both = points.withColumn("_kind", F.lit(0)).unionByName(
        queries.withColumn("_kind", F.lit(1)), allowMissingColumns=True
    )
    return both.groupBy(*keys).applyInArrow(_grid_unit(keys, kept), schema)


def _largest(points: DataFrame, queries: DataFrame, keys: Sequence[str]) -> int:
    sizes = points.select(*keys).unionByName(queries.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _solve(
    points: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    kept: Sequence[str],
    largest: int,
    units: int,
    bound: int,
    depth: int = 0,
) -> DataFrame:
    """Rows (keys, kept, _n, _s, _m) whose sums and maximum per query are its answer.

    Points carry `_a`, `_b`, `_n`, `_s`, `_m`, queries `_a`, `_b`; a point counts where its `_a` is below
    and its `_b` at or below the query's. `units` units of at most `largest` rows are cut along both.
    A unit that MAX_CUTS cuts leave too large is cut again by the same rule.
    """
    keys, kept = list(keys), list(kept)
    wanted = 2 * math.ceil(largest / bound)
    parts = max(min(wanted, MAX_CUTS), 2)
    shares = [i / parts for i in range(1, parts)]
    a_cuts, a_single = _cuts("_a", shares)
    b_cuts, b_single = _cuts("_b", shares)
    both = points.select(*keys, "_a", "_b").unionByName(queries.select(*keys, "_a", "_b"))
    cuts = both.groupBy(*keys).agg(
        a_cuts.alias("_cut_a"), a_single.alias("_one_a"), b_cuts.alias("_cut_b"), b_single.alias("_one_b")
    )
    cuts = cuts.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(keys)})
    if units * parts <= MAX_LISTED:
        cuts = F.broadcast(cuts)
    on = F.lit(True)
    for i, key in enumerate(keys):
        on = on & F.col(key).eqNullSafe(F.col(f"_h{i}"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(cuts, on).select(
            *rows.columns,
            _chunk_of(F.col("_a"), F.col("_cut_a")).alias("_ca"),
            _chunk_of(F.col("_b"), F.col("_cut_b")).alias("_cb"),
            F.array_contains("_one_a", F.col("_a")).alias("_sa"),
            F.array_contains("_one_b", F.col("_b")).alias("_sb"),
        )

    def part(p: DataFrame, q: DataFrame, by: list[str], keep: list[str], most: int = wanted) -> DataFrame:
        # Cut points are exact to a tenth of a part, so up to MAX_CUTS parts fit without being counted.
        if most <= MAX_CUTS:
            return _answered(p, q, by, keep)
        p, q = p.checkpoint(), q.checkpoint()
        size = _largest(p, q, by)
        if size <= bound:
            return _answered(p, q, by, keep)
        return _solve(p, q, by, keep, size, units * parts, bound, depth + 1)

    points, queries = placed(points), placed(queries)
    values, chunk = ["_a", "_b", "_n", "_s", "_m"], f"_c{depth}"
    # (a) Same chunk along the first time. A chunk of one value has no earlier points inside it.
    own = part(
        points.filter("NOT _sa").select(*keys, F.col("_ca").alias(chunk), *values),
        queries.filter("NOT _sa").select(*keys, F.col("_ca").alias(chunk), *kept, "_a", "_b"),
        [*keys, chunk],
        kept,
    )
    # (b) Earlier chunk along the first time, same chunk along the second.
    strip = part(
        points.filter("NOT _sb").select(
            *keys, F.col("_cb").alias(chunk), F.col("_ca").alias("_a"), *values[1:]
        ),
        queries.filter("NOT _sb").select(
            *keys, F.col("_cb").alias(chunk), *kept, F.col("_ca").alias("_a"), "_b"
        ),
        [*keys, chunk],
        kept,
    )
    # (c) Whole cells: earlier chunk along both times, or the same chunk along the second where that
    # chunk is one value. Only the distinct cells and corners are compared.
    upto = F.when(F.col("_sb"), F.col("_cb")).otherwise(F.col("_cb") - 1)
    corners = queries.select(*keys, *[F.col(k).alias(f"_k{k}") for k in kept], F.col("_ca").alias("_a"), upto.alias("_b"))
    cells = part(
        points.groupBy(*keys, F.col("_ca").alias("_a"), F.col("_cb").alias("_b")).agg(
            F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.max("_m").alias("_m")
        ),
        corners.select(*keys, "_a", "_b").distinct().withColumns({"_qa": F.col("_a"), "_qb": F.col("_b")}),
        keys,
        ["_qa", "_qb"],
        wanted if 4 * wanted * wanted <= bound else MAX_CUTS + 1,  # cells of a unit, not of a chunk
    )
    cells = cells.withColumnsRenamed({"_qa": "_a", "_qb": "_b"}).select(*keys, "_a", "_b", "_n", "_s", "_m")
    far = corners.join(cells, [*keys, "_a", "_b"])
    columns = [*kept, "_n", "_s", "_m"]
    far = far.select(*keys, *[F.col(f"_k{k}").alias(k) for k in kept], "_n", "_s", "_m")
    return own.select(*keys, *columns).unionByName(strip.select(*keys, *columns)).unionByName(far)


def _by_grid(large: DataFrame, scan: Scan, hot: Hot, row_id: str, rows_per_unit: int) -> DataFrame:
    """Entities larger than one unit: every question is a query, and its parts are summed."""
    keys = list(scan.keys)
    one = F.lit(1).cast("bigint")
    points = large.filter("_point").select(
        *keys, F.col("_u").alias("_a"), F.col("_v").alias("_b"), one.alias("_n"), F.col("_w").alias("_s"), F.col("_u").alias("_m")
    )
    until = dict(scan.until)
    slots = [
        F.struct(F.lit(s).alias("_slot"), (F.col("_u") - _back(b)).alias("_a"), F.col(until.get(s, "_y")).cast("bigint").alias("_b"))
        for s, b in scan.offsets
    ]
    queries = large.select(*keys, F.col(row_id).alias("_row"), F.inline(F.array(*slots)))
    each = 1 + len(scan.offsets)  # a row is a point and a query per slot
    bound = min(rows_per_unit * each, ASKED_AT_ONCE)
    parts = _solve(points, queries, keys, ["_row", "_slot"], hot.largest * each, hot.entities, bound)

    def slot(name: str, value: str) -> Column:
        return F.when(F.col("_slot") == name, F.col(value))

    wanted = [
        F.coalesce(F.sum(slot(s, "_n")), F.lit(0)).alias(f"{scan.prefix}_n_{s}") for s, _ in scan.offsets
    ]
    wanted += [F.coalesce(F.sum(slot(s, "_s")), F.lit(0)).alias(f"{scan.prefix}_s_{s}") for s in scan.sums]
    wanted += [F.max(slot(s, "_m")).alias(f"{scan.prefix}_last_{s}") for s in scan.last]
    totals = parts.groupBy("_row").agg(*wanted).withColumnRenamed("_row", row_id)
    return large.drop("_u", "_v", "_y", "_w", "_point").join(totals, row_id)
