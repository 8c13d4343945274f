"""Applying deliveries in arrival order: one status per delivery, as a sequential reader would give.

Every status depends on the statuses before it: the watermark and the known identities come from
applied rows only. Rows whose id and source occur once and that can not be late are applied whatever
happens to the others. The rest is solved by rounds: each round takes the statuses of the round
before, and the first rows of the order that are right stay right, so rounds that change nothing
have reached the sequential result. Repeats of an id settle in two or three rounds, however many there
are; rows that depend on each other through a chain of ids and sources would take a round for each link.
What still changes then is solved chain by chain, and checked by further rounds: a chain is reduced to the
deliveries that can change its state, and at most CHAIN_ROWS of them are read at once, from the first that
changed on; what follows them is read after the next rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidegate.functions.times import lit
from tidegate.operators.features import APPLIED, MAX_WINDOW, RETENTION
from tidegate.plans.components import components
from tidegate.plans.ordered import ROWS_PER_CHUNK, Chunked, chunked, last_before, running
from tidegate.session import written

DUPLICATE = "duplicate"
PAYLOAD_CONFLICT = "payload_conflict"
EVENT_ID_CONFLICT = "event_id_conflict"
LATE = "late_beyond_horizon"
STATUSES = (APPLIED, DUPLICATE, PAYLOAD_CONFLICT, LATE, EVENT_ID_CONFLICT)
# Statuses whose message is kept with a reason instead of being dropped.
ROUNDS = 3  # rounds before chains are solved by themselves
CHAIN_ROWS = 100_000  # deliveries of one chain that are read in one group
DEAD_LETTER_STATUSES = (PAYLOAD_CONFLICT, EVENT_ID_CONFLICT, LATE)


def apply_events(
    deliveries: DataFrame,
    retention_us: int = RETENTION,
    available: Column | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    watermark_us: int | None = None,
) -> DataFrame:
    """Add `status` to each delivery; arrival order is (available, seq).

    Rows need `seq`, `event_id`, `source_id`, `payload_hash`, `event_us` and `received_us`.
    `watermark_us` is the watermark that earlier deliveries, which are not among the rows, have left.
    """
    if retention_us < MAX_WINDOW:
        raise ValueError("retention_us is shorter than the longest window of the features")
    at = F.col("received_us") if available is None else available
    rows = deliveries.withColumn("_at", at)
    span = Observation()
    ids = F.array(
        F.struct(F.lit("event_id").alias("kind"), F.col("event_id").alias("key")),
        F.struct(F.lit("source_id").alias("kind"), F.col("source_id").alias("key")),
    )
    # Ids and sources that occur on several deliveries; the same pass measures the event times.
    several = (
        rows.observe(span, F.min("event_us").alias("low"), F.max("event_us").alias("high"))
        .select(F.inline(ids))
        .groupBy("kind", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .checkpoint()
    )
    try:
        low, high = span.get["low"], span.get["high"]
    except Py4JJavaError:  # nothing is observed when the plan was reduced to no rows
        low = None
    if low is None:
        return deliveries.withColumn("status", F.lit(None).cast("string"))
    newest = max(high, watermark_us if watermark_us is not None else high)
    horizon_matters = newest - retention_us > low

    for key in ("event_id", "source_id"):
        found = several.filter(F.col("kind") == key).select(F.col("key").alias(key), F.lit(True).alias(f"_r_{key}"))
        rows = rows.join(found, key, "left")
    rows = rows.withColumns({"_open": F.coalesce("_r_event_id", "_r_source_id", F.lit(False)), "payload_hash": _short("payload_hash")})
    names = ["seq", "event_id", "source_id", "payload_hash", "event_us", "_at", "_open"]
    rows = rows.select(*names)
    if horizon_matters:
        rows = _with_watermark_bound(rows, retention_us, rows_per_chunk, watermark_us)
    else:
        rows = rows.withColumn("_base", F.lit(None).cast("bigint"))
    open_rows = written(rows.filter("_open").drop("_open"), "open", "zstd")
    most = several.agg(F.max("n")).first()[0] or 0
    settled = _rounds(open_rows, retention_us, horizon_matters, rows_per_chunk, small=most <= rows_per_chunk)
    return deliveries.join(settled.select("seq", "status"), "seq", "left").withColumn(
        "status", F.coalesce("status", F.lit(APPLIED))
    )


def _with_watermark_bound(
    rows: DataFrame, retention_us: int, rows_per_chunk: int, watermark_us: int | None
) -> DataFrame:
    """Mark possible late rows as open, and give open rows the watermark of all certain rows.

    Certain rows are applied in every case, so their running maximum is computed once.
    """
    chunks = chunked(rows, [F.col("_at"), F.col("seq")], rows_per_chunk, "_c")
    order = [F.col("_at"), F.col("seq")]
    upper = running(chunks, order, {"_upper": ("max", F.col("event_us"))}, inclusive=False)
    before = F.lit(watermark_us).cast("bigint")
    highest = F.greatest(F.col("_upper"), before)
    late = F.coalesce(F.col("event_us") < highest - F.lit(retention_us), F.lit(False))
    marked = upper.withColumn("_open", F.col("_open") | late).checkpoint()
    certain = F.when(~F.col("_open"), F.col("event_us"))
    bounded = running(Chunked(marked, "_c", chunks.single), order, {"_base": ("max", certain)}, inclusive=False)
    return bounded.withColumn("_base", F.greatest("_base", before)).drop("_c", "_upper")


def _rounds(
    open_rows: DataFrame, retention_us: int, horizon_matters: bool, rows_per_chunk: int, small: bool
) -> DataFrame:
    """`small`: no id or source has more rows than a chunk, so that their rows are read without cuts."""
    chunks = chunked(open_rows, [F.col("_at"), F.col("seq")], rows_per_chunk, "_c")
    state = chunks.df.withColumn("status", F.lit(APPLIED))
    order, count, roots = ["_at", "seq"], 0, None
    while True:
        applied = F.col("status") == APPLIED
        seen, owner = F.struct("event_us", "payload_hash", "source_id"), F.struct("event_us", "event_id")
        step = Chunked(state, "_c", chunks.single)
        step = Chunked(last_before(step, order, ["event_id"], applied, seen, "_seen", small), "_c", chunks.single)
        step = Chunked(last_before(step, order, ["source_id"], applied, owner, "_owner", small), "_c", chunks.single)
        if horizon_matters:
            marked = running(
                step,
                [F.col(c) for c in order],
                {"_mark": ("max", F.when(applied, F.col("event_us")))},
                inclusive=False,
            )
            horizon = F.greatest("_mark", "_base") - F.lit(retention_us)
        else:
            marked, horizon = step.df, F.lit(None).cast("bigint")
        count += 1
        # What a status was read from is kept for rounds that may solve chains.
        read = ["_horizon", "_seen", "_owner"] if count % ROUNDS == 0 else []
        state_next = marked.withColumn("_next", _status(horizon)).withColumn("_horizon", horizon).select(*state.columns, "_next", *read)
        state_next = written(state_next, "round", "zstd")
        changed = not state_next.filter("_next <> status").isEmpty()
        if changed and count % ROUNDS == 0:
            if roots is None:
                event, source = _nodes()
                edges = open_rows.select(event.alias("a"), source.alias("b")).distinct()
                roots = components(edges).withColumnsRenamed({"node": "_a", "root": "_chain"})
            state_next = _by_chain(Chunked(state_next, "_c", chunks.single), roots, retention_us, horizon_matters).checkpoint()
        state = state_next.withColumn("status", F.col("_next")).select(*state.columns)
        if not changed:
            return state


def _short(text: str) -> Column:
    """A text as bytes that are equal where the texts are; one of lower-case hexadecimal digits takes half the room."""
    digits = F.unhex(F.when(F.col(text).rlike("^([0-9a-f]{2})+$"), F.col(text)))
    return F.coalesce(F.concat(F.lit(b"h"), digits), F.concat(F.lit(b"t"), F.encode(text, "UTF-8")))


def _nodes() -> tuple[Column, Column]:
    return F.xxhash64(F.lit("event"), "event_id"), F.xxhash64(F.lit("source"), "source_id")


def _by_chain(state: Chunked, roots: DataFrame, retention_us: int, horizon_matters: bool) -> DataFrame:
    """`_next` of rows whose chain still changes, read in order within each chain of shared ids and sources.

    The horizon that other rows give is taken as it stands; a chain's own rows move it as they are applied. What comes
    before a chain's first change is right, and enters as the records that the rows after it see first."""
    columns = state.df.columns
    placed = state.df.withColumn("_a", _nodes()[0]).join(roots, "_a").drop("_a")
    change = F.struct(F.col("_at").alias("at"), F.col("seq").alias("seq"))
    moving = placed.filter("_next <> status").groupBy("_chain").agg(F.min(change).alias("_from")).checkpoint()
    few = moving.count() <= 10_000
    placed = placed.join(F.broadcast(moving) if few else moving, "_chain", "left")
    open_ = F.coalesce(change >= F.col("_from"), F.lit(False))
    if horizon_matters:
        # What moves a chain's horizon from outside: applied rows that are not to be read again themselves.
        # `_most` is what the horizon could be if all rows were applied.
        sure = F.when((F.col("status") == APPLIED) & ~open_, F.col("event_us"))
        marks = {"_sure": ("max", sure), "_top": ("max", F.col("event_us"))}
        placed = running(Chunked(placed, state.column, state.single), [F.col("_at"), F.col("seq")], marks, inclusive=False)
        placed = placed.withColumns({to: F.greatest(of, "_base") - F.lit(retention_us) for to, of in (("_horizon", "_sure"), ("_most", "_top"))})
        placed = placed.drop("_sure", "_top").checkpoint()
    telling = _telling(Chunked(placed.filter(open_), state.column, state.single), horizon_matters)
    # The first CHAIN_ROWS of each chain; what lies between them and is not telling can not be applied.
    numbered = running(Chunked(telling, state.column, state.single), [F.col("_at"), F.col("seq")], {"_n": ("sum", lit(1))}, ["_chain"])
    read = numbered.filter(F.col("_n") <= CHAIN_ROWS).checkpoint()
    upto = read.groupBy("_chain").agg(F.max(change).alias("_last"), F.count(F.lit(1)).alias("_k"))
    ends = F.when(F.col("_k") == CHAIN_ROWS, F.col("_last"))  # shorter chains are read to their end
    fields = ["seq", "event_id", "source_id", "payload_hash", "event_us", "_at", "_horizon"]
    seen = [F.col(f"_seen.{c}").alias(f"_seen_{c}") for c in ("event_us", "payload_hash", "source_id")]
    owner = [F.col(f"_owner.{c}").alias(f"_owner_{c}") for c in ("event_us", "event_id")]
    solved = read.select("_chain", *fields, *seen, *owner).groupBy("_chain").applyInPandas(_reader(retention_us), "seq bigint, _solved string")
    spans = upto.select("_chain", ends.alias("_end"))
    inside = open_ & F.coalesce(change <= F.col("_end"), F.lit(True))
    repeat = F.when(inside & (F.col("_next") == APPLIED), F.lit(DUPLICATE)).otherwise(F.col("_next"))
    out = placed.join(F.broadcast(spans) if few else spans, "_chain", "left").join(solved, "seq", "left")
    return out.withColumn("_next", F.coalesce("_solved", repeat)).select(*columns)


def _telling(rows: Chunked, horizon_matters: bool) -> DataFrame:
    """The deliveries of each chain that can be applied: the first of an equal id, source, payload and time, and the
    first of them after the horizon has passed an event of the same id or source, which may have stood in the way.

    An applied delivery's repeats are duplicates until both are late; a refused one's repeats are refused while
    what refused it lives. Where the chain's own rows decide whether the horizon has passed such an event, all are kept."""
    same = ["event_id", "source_id", "payload_hash", "event_us"]
    place = F.struct(F.col("_at").alias("at"), F.col("seq").alias("seq"))
    marked, unsure = rows.df, F.lit(False)
    if horizon_matters:
        for key in ("event_id", "source_id"):
            times = marked.select(key, F.col("event_us").alias("_v")).distinct().withColumn("_w", lit(1))
            asked = marked.select(key, F.explode(F.array("_horizon", "_most")).alias("_v")).distinct().filter("_v is not null")
            both = asked.withColumn("_w", lit(0)).unionByName(times).checkpoint()
            # Events before a horizon: those of the same instant are counted after it.
            cut = chunked(both, [F.col("_v")], column="_k")
            passed = running(cut, [F.col("_v"), F.col("_w")], {"_n": ("sum", F.col("_w"))}, [key]).filter("_w = 0").select(key, "_v", "_n")
            for horizon in ("_horizon", "_most"):
                marked = marked.join(passed.withColumnsRenamed({"_v": horizon, "_n": f"{horizon}_{key}"}), [key, horizon], "left")
            low, high = (F.coalesce(f"{horizon}_{key}", lit(0)) for horizon in ("_horizon", "_most"))
            unsure, same = unsure | (low != high), [*same, f"_horizon_{key}"]
    # A row of which it is not sure is its own first.
    kept = marked.withColumn("_alone", F.when(unsure, F.col("seq"))).groupBy(*same, "_alone").agg(F.min(place).alias("_first"))
    return rows.df.join(kept.select(F.col("_first.seq").alias("seq")), "seq", "left_semi")


def _reader(retention_us: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Statuses of the rows of one chain as a sequential reader gives them."""
    names = ("event_id", "source_id", "payload_hash", "event_us", "_horizon")
    before = ("_seen_event_us", "_seen_payload_hash", "_seen_source_id", "_owner_event_us", "_owner_event_id")

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_at", "seq"])
        seen: dict = {}
        owner: dict = {}
        newest, out = None, []
        fields = zip(*(rows[c].tolist() for c in names + before), strict=True)
        for event_id, source_id, payload, at, horizon, seen_at, seen_payload, seen_source, owner_at, owner_id in fields:
            # The first mention of an id or source brings what earlier rows left.
            if event_id not in seen:
                seen[event_id] = None if seen_at is None or seen_at != seen_at else (int(seen_at), seen_payload, seen_source)
            if source_id not in owner:
                owner[source_id] = None if owner_at is None or owner_at != owner_at else (int(owner_at), owner_id)
            limit = None if horizon is None or horizon != horizon else int(horizon)
            if limit is not None and newest is not None:
                limit = max(limit, newest - retention_us)
            known, held = seen[event_id], owner[source_id]
            known = known if known and (limit is None or known[0] >= limit) else None
            held = held if held and (limit is None or held[0] >= limit) else None
            if limit is not None and at < limit:
                status = LATE
            elif known:
                status = PAYLOAD_CONFLICT if known[1] != payload else EVENT_ID_CONFLICT if known[2] != source_id else DUPLICATE
            elif held and held[1] != event_id:
                status = EVENT_ID_CONFLICT
            else:
                status = APPLIED
                seen[event_id], owner[source_id] = (at, payload, source_id), (at, event_id)
                newest = at if newest is None else max(newest, at)
            out.append(status)
        return pd.DataFrame({"seq": rows["seq"], "_solved": out})

    return read


def _status(horizon: Column) -> Column:
    """The order of the checks decides which status a delivery gets."""

    def alive(record: str) -> Column:
        within = F.coalesce(F.col(f"{record}.event_us") >= horizon, F.lit(True))
        return F.col(record).isNotNull() & within

    return (
        F.when(F.coalesce(F.col("event_us") < horizon, F.lit(False)), F.lit(LATE))
        .when(alive("_seen") & (F.col("_seen.payload_hash") != F.col("payload_hash")), F.lit(PAYLOAD_CONFLICT))
        .when(alive("_seen") & (F.col("_seen.source_id") != F.col("source_id")), F.lit(EVENT_ID_CONFLICT))
        .when(alive("_seen"), F.lit(DUPLICATE))
        .when(alive("_owner") & (F.col("_owner.event_id") != F.col("event_id")), F.lit(EVENT_ID_CONFLICT))
        .otherwise(F.lit(APPLIED))
    )


def status_counts(applied: DataFrame) -> DataFrame:
    return applied.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def entity_metadata(applied: DataFrame, entity: str, available: Column | None = None) -> DataFrame:
    """Per entity: applied events, when the newest was applied, and which one it was."""
    at = F.col("received_us") if available is None else available
    rows = applied.filter(F.col("status") == APPLIED).withColumn("_at", at)
    return rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("applied_count"),
        F.max("_at").alias("last_applied_us"),
        F.max_by("event_id", F.struct("_at", "seq")).alias("last_event_id"),
    )


def retained(applied: DataFrame, as_of_us: int, retention_us: int = RETENTION) -> DataFrame:
    """The history kept at an instant: applied events not older than the horizon of that instant."""
    arrived = applied.filter((F.col("status") == APPLIED) & (F.col("received_us") <= as_of_us))
    watermark = arrived.agg(F.max("event_us").alias("w")).scalar()
    return arrived.filter(F.col("event_us") >= watermark - F.lit(retention_us))


def live_identities(applied: DataFrame, as_of_us: int, retention_us: int = RETENTION) -> DataFrame:
    """Identity records that still block a repeated id or source at an instant, newest per id."""
    return (
        retained(applied, as_of_us, retention_us)
        .groupBy("event_id")
        .agg(
            F.max_by(
                F.struct("source_id", "payload_hash", "event_us"), F.struct("received_us", "seq")
            ).alias("r")
        )
        .select("event_id", "r.*")
    )
