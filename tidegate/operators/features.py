"""Point-in-time behavioural features, version f1.

A prior event is history of a decision if it happened in [t - window, t) and had arrived by the
decision. Both conditions are exact: lower bound inclusive, upper bound exclusive, an event that
arrives at the decision's own microsecond is visible, and a row never sees its own event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.times import DAY, HOUR, US, day_of_week, hour_of_day, lit
from tidegate.session import written
from tidegate.plans.visibility import ROWS_PER_UNIT, Scan, oversized, visible

# Fixed values of feature version f1.
FEATURE_VERSION = "f1"
CUSTOMER_WINDOWS = {"1h": HOUR, "1d": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
AMOUNT_WINDOWS = ("7d", "30d")
TERMINAL_WINDOWS = {"1d": DAY, "7d": 7 * DAY}
MAX_WINDOW = 30 * DAY
RETENTION = MAX_WINDOW + DAY
FEATURES = (
    "amount_minor",
    "hour_of_day_utc",
    "day_of_week_utc",
    "cust_txn_count_1h",
    "cust_txn_count_1d",
    "cust_txn_count_7d",
    "cust_txn_count_30d",
    "cust_amount_mean_7d",
    "cust_amount_mean_30d",
    "amount_to_cust_mean_30d",
    "secs_since_prev_cust_txn",
    "cust_has_history_30d",
    "cust_terminal_is_new_30d",
    "term_txn_count_1d",
    "term_txn_count_7d",
)
APPLIED = "applied"


def available_at(delay_us: int = 0, availability: str = "arrival") -> Column:
    """When an event becomes history. `event_time` ignores arrival and exists to measure the leak."""
    if delay_us < 0:
        raise ValueError("delay_us is below zero")
    if availability == "event_time":
        return F.col("event_us")
    if availability != "arrival":
        raise ValueError(f"availability is arrival or event_time, not {availability}")
    return F.col("received_us") + lit(delay_us)


def point_in_time(
    txns: DataFrame,
    delay_us: int = 0,
    availability: str = "arrival",
    retention_us: int = RETENTION,
    repeated_ids: bool = False,
    rows_per_unit: int = ROWS_PER_UNIT,
    watermark_us: int | None = None,
) -> DataFrame:
    """One row per input row with its decision time, the fifteen features and `history_complete`.

    `watermark_us` is the newest applied event time of a history that is larger than the rows given.

    Rows need `seq` (unique), `event_id`, `customer_id`, `terminal_id`, `amount_minor`, `event_us`
    and `received_us`. With a `status` column only applied rows are history. `repeated_ids` says
    that one event id may occur on several rows, whose own event must then be left out. The rows are
    written once as Parquet, so that whatever they come from is computed once; each later step reads the
    columns it needs.
    """
    txns = written(txns, "decisions")
    is_point = F.col("status") == APPLIED if "status" in txns.columns else F.lit(True)
    available = available_at(delay_us, availability)
    base = txns.withColumn("decision_us", F.col("received_us"))
    own: tuple[tuple[str, str], ...] = ()
    if repeated_ids:
        base = _own_event(base, available, is_point)
        own = (("own", "_own_back"),)
    last = ("now", *[slot for slot, _ in own])
    customer = Scan(
        "c",
        ("customer_id",),
        (("now", 0), *CUSTOMER_WINDOWS.items(), *own),
        sums=("now", *AMOUNT_WINDOWS),
        last=last,
    )
    pair = Scan("p", ("customer_id", "terminal_id"), (("now", 0), *own), last=last)
    terminal = Scan("t", ("terminal_id",), (("now", 0), *TERMINAL_WINDOWS.items()))
    base, rows = history_complete(base, available, is_point, retention_us, watermark_us)
    args = dict(
        event_us="event_us",
        available_us=available,
        decision_us="decision_us",
        weight="amount_minor",
        is_point=is_point,
        row_id="seq",
        rows=rows,
        rows_per_unit=rows_per_unit,
    )
    hot_customers = oversized(txns, customer.keys, rows, rows_per_unit)
    hot_terminals = oversized(txns, terminal.keys, rows, rows_per_unit)
    seen = visible(base, [customer, pair], hot=hot_customers, **args)
    if hot_terminals.entities:
        seen = seen.checkpoint()
    seen = visible(seen, [terminal], hot=hot_terminals, **args)
    added = [f for f in FEATURES if f not in txns.columns]
    return _features(seen, repeated_ids).select(
        *txns.columns, "decision_us", *added, "history_complete"
    )


def changes(txns: DataFrame, seen_until: dict[str, Column], rows_per_unit: int = ROWS_PER_UNIT) -> DataFrame:
    """(seq, variant, changed): whether a decision's vector changes when it sees what had arrived by another time.

    A vector changes if and only if an event enters or leaves the customer's 30 days or the terminal's 7 days, as
    each of them is counted by a feature. So no vector is computed: one pass over the history counts, for every
    decision and variant, the events of these two windows, however many variants there are; a row is an event once. Columns of
    `seen_until` give the time up to which arrivals are seen; event ids must not repeat."""
    columns = ["seq", "event_id", "customer_id", "terminal_id", "amount_minor", "event_us", "received_us"]
    base = written(txns.select(*columns), "decisions")
    rows = base.count()
    until = [f"_until_{i}" for i in range(len(seen_until))]
    seen = base.withColumns({name: u.cast("long") for name, u in zip(until, seen_until.values(), strict=True)})
    widths = {"c": ("customer_id", MAX_WINDOW), "t": ("terminal_id", max(TERMINAL_WINDOWS.values()))}
    for prefix, (key, width) in widths.items():
        offsets = [(f"{slot}{name}", back) for name in ("", *until) for slot, back in (("now", 0), ("from", width))]
        asked = [(f"{slot}{name}", name) for name in until for slot in ("now", "from")]
        scan = Scan(prefix, (key,), tuple(offsets), until=tuple(asked))
        hot = oversized(base, scan.keys, rows, rows_per_unit)
        if hot.entities:
            seen = seen.checkpoint()
        seen = visible(
            seen, [scan], event_us="event_us", available_us=F.col("received_us"), decision_us="received_us", weight="amount_minor",
            is_point=F.lit(True), row_id="seq", rows=rows, rows_per_unit=rows_per_unit, hot=hot,
        )

    def counted(name: str) -> Column:
        return F.struct(*[F.col(f"{p}_n_now{name}") - F.col(f"{p}_n_from{name}") for p in widths])

    variants = [F.struct(F.lit(v).alias("variant"), (counted("") != counted(n)).alias("changed")) for v, n in zip(seen_until, until, strict=True)]
    return seen.select("seq", F.inline(F.array(*variants)))


def _own_event(base: DataFrame, available: Column, is_point: Column) -> DataFrame:
    """The applied event that carries a row's own id, where it would fall into the row's history."""
    own = (
        base.filter(is_point)
        .groupBy("event_id")
        # An id is applied again only after its record expired; the newest application counts.
        .agg(
            F.max_by(
                F.struct("event_us", available.alias("at"), "amount_minor", "customer_id", "terminal_id"),
                available,
            ).alias("_o")
        )
    )
    joined = base.join(own, "event_id", "left")
    seen = F.coalesce(
        (F.col("_o.event_us") < F.col("event_us")) & (F.col("_o.at") <= F.col("decision_us")),
        F.lit(False),
    )
    return joined.select(
        *base.columns,
        F.when(seen, F.col("event_us") - F.col("_o.event_us")).otherwise(lit(0)).alias("_own_back"),
        F.when(seen, F.col("_o.amount_minor")).otherwise(lit(0)).alias("_own_amount"),
        F.when(seen, F.col("_o.customer_id").eqNullSafe(F.col("customer_id")))
        .otherwise(F.lit(False))
        .alias("_own_customer"),
        F.when(seen, F.col("_o.terminal_id").eqNullSafe(F.col("terminal_id")))
        .otherwise(F.lit(False))
        .alias("_own_terminal"),
    )


def _features(seen: DataFrame, repeated_ids: bool) -> DataFrame:
    t = F.col("event_us")

    def less(condition: Column, slot_back: int, value: Column) -> Column:
        """What the row's own event adds to the part of the history before `t - slot_back`."""
        if not repeated_ids:
            return lit(0)
        return F.when(condition & (F.col("_own_back") > lit(slot_back)), value).otherwise(lit(0))

    same_customer = F.col("_own_customer") if repeated_ids else F.lit(False)
    same_terminal = F.col("_own_terminal") if repeated_ids else F.lit(False)
    own_amount = F.col("_own_amount") if repeated_ids else lit(0)

    def between(prefix: str, slot: str, back: int, condition: Column, kind: str = "n") -> Column:
        value = lit(1) if kind == "n" else own_amount
        now = F.col(f"{prefix}_{kind}_now") - less(condition, 0, value)
        return now - (F.col(f"{prefix}_{kind}_{slot}") - less(condition, back, value))

    def newest(prefix: str, condition: Column) -> Column:
        now = F.col(f"{prefix}_last_now")
        if not repeated_ids:
            return now
        alone = F.col(f"{prefix}_n_now") - F.col(f"{prefix}_n_own") == 1
        return F.when(condition & alone, F.col(f"{prefix}_last_own")).otherwise(now)

    out = seen
    for name, width in CUSTOMER_WINDOWS.items():
        out = out.withColumn(f"cust_txn_count_{name}", between("c", name, width, same_customer))
    for name in AMOUNT_WINDOWS:
        total = between("c", name, CUSTOMER_WINDOWS[name], same_customer, "s")
        count = F.col(f"cust_txn_count_{name}")
        out = out.withColumn(
            f"cust_amount_mean_{name}", F.when(count > 0, total.cast("double") / count.cast("double"))
        )
    mean = F.col("cust_amount_mean_30d")
    start = t - lit(MAX_WINDOW)
    previous = newest("c", same_customer)
    pair = newest("p", same_customer & same_terminal)
    out = out.withColumns(
        {
            "hour_of_day_utc": hour_of_day(t),
            "day_of_week_utc": day_of_week(t),
            "amount_to_cust_mean_30d": F.when(
                mean > 0, F.col("amount_minor").cast("double") / mean
            ),
            "secs_since_prev_cust_txn": F.when(
                previous >= start, (t - previous).cast("double") / F.lit(float(US))
            ),
            "cust_has_history_30d": (F.col("cust_txn_count_30d") > 0).cast("bigint"),
            "cust_terminal_is_new_30d": F.when(pair >= start, lit(0)).otherwise(lit(1)),
        }
    )
    for name, width in TERMINAL_WINDOWS.items():
        out = out.withColumn(f"term_txn_count_{name}", between("t", name, width, same_terminal))
    return out


def history_complete(
    rows: DataFrame,
    available: Column,
    is_point: Column,
    retention_us: int = RETENTION,
    watermark_us: int | None = None,
) -> tuple[DataFrame, int]:
    """Add whether retention can not yet have trimmed a row's widest window at its decision.

    The watermark is the newest applied event time that had arrived. It is bounded per arrival hour
    in one small table; only rows that fall between an hour's bounds are looked up per second and
    microsecond, where the number of distinct values is limited by the clock and not by the data.
    The same table gives the number of rows, which is returned as well. `watermark_us` is known before
    all rows.
    """
    if retention_us < MAX_WINDOW:
        raise ValueError("retention_us is shorter than the longest window of the features")
    slack = retention_us - MAX_WINDOW
    nothing = F.lit(None).cast("bigint")
    event, decided = F.col("event_us"), F.col("decision_us")
    marks = F.array(
        F.struct(
            F.floor(available / HOUR).alias("hour"),
            F.when(is_point, event).alias("top"),
            nothing.alias("oldest"),
            lit(0).alias("n"),
        ),
        F.struct(
            F.floor(decided / HOUR).alias("hour"),
            nothing.alias("top"),
            event.alias("oldest"),
            lit(1).alias("n"),
        ),
    )
    upto = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    earlier_mark = F.lit(watermark_us).cast("bigint")
    high = F.greatest(F.max("top").over(upto), earlier_mark)
    hours = (
        rows.select(F.inline(marks))
        .groupBy("hour")
        .agg(F.max("top").alias("top"), F.min("oldest").alias("oldest"), F.sum("n").alias("n"))
        .select(
            F.col("hour").alias("_hour"),
            F.greatest(F.max("top").over(before), earlier_mark).alias("_low"),
            high.alias("_high"),
            F.coalesce(high > F.col("oldest") + lit(slack), F.lit(False)).alias("_check"),
            "n",
        )
        .checkpoint()
    )
    found = hours.agg(F.sum("n").alias("n"), F.bool_or("_check").alias("check")).first()
    count = int(found["n"] or 0)
    if not found["check"]:
        return rows.withColumn("history_complete", F.lit(True)), count
    limit = event + lit(slack)
    bounded = rows.withColumn("_hour", F.floor(decided / HOUR)).join(hours.drop("n", "_check"), "_hour")
    unsure = F.coalesce(F.col("_high") > limit, F.lit(False)) & F.coalesce(
        F.col("_low") <= limit, F.lit(True)
    )
    asked = bounded.filter(unsure).select("_hour", decided.alias("_at")).distinct().checkpoint()
    ticks = (
        rows.filter(is_point)
        .select(F.floor(available / HOUR).alias("_hour"), available.alias("_at"), event.alias("_event"))
        .join(asked.select("_hour").distinct(), "_hour", "left_semi")
        .unionByName(asked.withColumn("_event", nothing))
        .groupBy("_hour", "_at")
        .agg(F.max("_event").alias("_event"))
        .withColumn("_second", F.floor(F.col("_at") / US))
    )
    inside = Window.partitionBy("_second").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_hour").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    seconds = (
        ticks.groupBy("_hour", "_second")
        .agg(F.max("_event").alias("_top"))
        .select("_second", F.max("_top").over(earlier).alias("_carried"))
    )
    exact = (
        ticks.withColumn("_inside", F.max("_event").over(inside))
        .join(seconds, "_second")
        .select(F.col("_at").alias("decision_us"), F.greatest("_inside", "_carried").alias("_exact"))
    )
    flag = (
        F.when(F.col("_high").isNull() | (F.col("_high") <= limit), F.lit(True))
        .when(~unsure, F.lit(False))
        .otherwise(F.coalesce(F.greatest("_low", "_exact") <= limit, F.lit(True)))
    )
    out = bounded.join(exact, "decision_us", "left").withColumn("history_complete", flag)
    return out.select(*rows.columns, "history_complete"), count
