"""Keyed streaming state: identities, source owners and histories that leave by event-time timers.

Deliveries pass four keyed operators of one streaming query:

* by event id: is the id new, a repeat, or in conflict with its first delivery;
* by source id of the id's first delivery: does another id own the source; its verdict is the status;
* by customer, then by terminal: the features that the decision could see, and the applied event added.

State lives in the RocksDB store of the query. Keys are dealt to a fixed number of groups by a hash, and the state of
a group is read and written as a whole: an exchange with the store costs as much for one id as for thousands. A batch
reads and writes only the groups that it mentions, so its cost follows its rows and the size of a group, not the
number of batches, and nothing outlives the horizon: timers remove a record when the watermark has passed its event,
and a day of a history when it has passed the day. The watermark is the newest event time less the retention, as it
stood after the batch before, which makes it the horizon of a whole batch.

Between the operators rows travel as packs: an Arrow table of the rows of a task that belong to one group.

What differs from `streaming.pipeline`, which is exact to the row: the horizon moves between batches; refused
events move it as well; an id whose first delivery found its source taken stays refused until its record expires.
A group's rows of one batch are read by one task and answered together, by sorts.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegate.functions.times import DAY, US, day_of_week, hour_of_day, lit
from tidegate.operators.apply import DUPLICATE, EVENT_ID_CONFLICT, LATE, PAYLOAD_CONFLICT
from tidegate.operators.features import APPLIED, CUSTOMER_WINDOWS, FEATURES, MAX_WINDOW, RETENTION, TERMINAL_WINDOWS
from tidegate.plans.visibility import NOTHING, count_visible

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = (
    "seq long, event_id string, customer_id string, terminal_id string, amount_minor long, event_us long, "
    "received_us long, payload_hash string, source_id string, clock timestamp"
)
_STATUS = _EVENT + ", status string"
_CUSTOMER = (
    "horizon_us long, cust_txn_count_1h long, cust_txn_count_1d long, cust_txn_count_7d long, cust_txn_count_30d long, "
    "cust_amount_7d long, cust_amount_30d long, previous_us long, pair_seen boolean"
)
_TERMINAL = "term_txn_count_1d long, term_txn_count_7d long"
_NEW = "new"


GROUPS = 1024  # groups of keys, where the caller does not know how many keys live at once
_PACK = "group long, rows binary"
_Pack = Row("group", "rows")
_ROWS_PACKED = 200_000  # rows of a task that are dealt to groups together
_TYPES = {"long": pa.int64(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "boolean": pa.bool_()}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])


_DAY = _arrow("amount long, name string, other string, entity string")  # what a day keeps beside the times


def _bytes(table: pa.Table, compression: str | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def _packer(key: str, groups: int, packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals rows, or the rows of packs, to the groups of `key`: one pack for each group with rows."""

    def dealt(tables: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(tables).combine_chunks()
        group = np.array([0 if x is None else zlib.crc32(x.encode()) % groups for x in rows[key].to_pylist()], np.int64)
        order = np.argsort(group, kind="stable")
        group, rows = group[order], rows.take(pa.array(order))
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(starts[1:], group.size)
        packs = [_bytes(rows.slice(low, high - low)) for low, high in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(group[starts]), pa.array(packs, pa.binary())], ["group", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            tables = [_table(x.as_buffer()) for x in batch["rows"]] if packed else [pa.Table.from_batches([batch])]
            for table in tables:
                waiting.append(table)
                if sum(t.num_rows for t in waiting) >= _ROWS_PACKED:
                    yield dealt(waiting)
                    waiting = []
        if any(t.num_rows for t in waiting):
            yield dealt(waiting)

    return pack


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from pa.concat_tables([_table(x.as_buffer()) for x in batch["rows"]]).combine_chunks().to_batches(10_000)


def _horizon(timers) -> int | None:
    """Events before it are late and records before it dead; none before the first batch has ended."""
    at = timers.getCurrentWatermarkInMs()
    return at * 1000 if at > 0 else None


def _arrived(packs: Iterator[Row]) -> pa.Table:
    """The rows of a group's packs in order of arrival."""
    return pa.concat_tables([_table(p["rows"]) for p in packs]).sort_by([("received_us", "ascending"), ("seq", "ascending")])


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    if column.null_count:
        raise ValueError("a delivery has no time")
    return column.to_numpy().astype("<i8", copy=False)


class _Records(StatefulProcessor):
    """Keyed by a group of ids: the first living record of each, until the watermark passes its event.

    `state` holds all records of the group as one table, with their number and the oldest event, whose timer is set."""

    state, schema = "", pa.schema([])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getValueState(self.state, "event_us long, kept long, records binary")

    def _living(self, horizon: int | None) -> pa.Table:
        found = self.records.get()
        self.timed = None if found is None else found[0]
        if found is None:
            return self.schema.empty_table()
        held = _table(found[2])
        return held if horizon is None or found[0] >= horizon else held.filter(pa.array(_longs(held["event_us"]) >= horizon))

    def _keep(self, held: pa.Table, added: list[tuple]) -> None:
        """Write the living records and those `added`, in the order of the schema; the oldest has a timer."""
        new = pa.table([pa.array(c, f.type) for c, f in zip(zip(*added, strict=True), self.schema, strict=True)], self.schema) if added else held.slice(0, 0)
        held = pa.concat_tables([held, new]).combine_chunks()
        if not held.num_rows:
            self.records.clear()
            return
        oldest = int(_longs(held["event_us"]).min())
        self.records.update((oldest, held.num_rows, _bytes(held, "zstd")))
        if oldest != self.timed:
            self.handle.registerTimer(oldest // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        found = self.records.get()
        # An older timer of a group may find that its records have left.
        if found is not None and found[0] // 1000 + 1 <= timerValues.getCurrentWatermarkInMs():
            self._keep(self._living(_horizon(timerValues)), [])
        return iter([])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        first = _table(initialState["rows"]).select(self.schema.names).cast(self.schema)
        self._keep(pa.concat_tables([self._living(None), first]), [])


class Identities(_Records):
    """Keyed by a group of event ids: what its first living delivery says about each delivery."""

    state = "record"
    schema = _arrow("event_id string, payload_hash string, source_id string, event_us long")

    def handleInputRows(self, key, rows, timerValues):
        horizon, batch = _horizon(timerValues), _arrived(rows)
        held = self._living(horizon)
        known = dict(zip(held["event_id"].to_pylist(), zip(held["payload_hash"].to_pylist(), held["source_id"].to_pylist(), strict=True), strict=True))
        added, opinions, claims = [], [], []
        columns = (batch[c].to_pylist() for c in ("event_id", "payload_hash", "source_id", "event_us"))
        for event_id, payload, source, event_us in zip(*columns, strict=True):
            record = known.get(event_id)
            if horizon is not None and event_us < horizon:
                opinion, record = LATE, (payload, source)
            elif record is None:
                opinion, record = _NEW, (payload, source)
                known[event_id] = record
                added.append((event_id, payload, source, event_us))
            elif record[0] != payload:
                opinion = PAYLOAD_CONFLICT
            else:
                opinion = DUPLICATE if record[1] == source else EVENT_ID_CONFLICT
            opinions.append(opinion)
            claims.append(record[1])
        if added:
            self._keep(held, added)
        out = batch.append_column("opinion", pa.array(opinions, pa.string())).append_column("claim", pa.array(claims, pa.string()))
        yield _Pack(key[0], _bytes(out))


class Owners(_Records):
    """Keyed by a group of the sources that ids claimed first: the owner's deliveries keep what their id says, others conflict."""

    state = "owner"
    schema = _arrow("claim string, event_id string, event_us long")

    def handleInputRows(self, key, rows, timerValues):
        horizon, batch = _horizon(timerValues), _arrived(rows)
        held = self._living(horizon)
        owners = dict(zip(held["claim"].to_pylist(), held["event_id"].to_pylist(), strict=True))
        added, statuses = [], []
        columns = (batch[c].to_pylist() for c in ("claim", "event_id", "event_us", "opinion"))
        for claim, event_id, event_us, opinion in zip(*columns, strict=True):
            if opinion == LATE:
                status = LATE
            elif opinion == _NEW and claim not in owners:
                status, owners[claim] = APPLIED, event_id
                added.append((claim, event_id, event_us))
            else:
                mine = claim in owners and owners[claim] == event_id
                status = opinion if mine and opinion != _NEW else APPLIED if mine else EVENT_ID_CONFLICT
            statuses.append(status)
        if added:
            self._keep(held, added)
        out = batch.drop_columns(["opinion", "claim"]).append_column("status", pa.array(statuses, pa.string()))
        yield _Pack(key[0], _bytes(out))


_FRESH = 2_000  # events that are searched beside the sorted arrays before they are merged into them
_FEW = 8  # rows of a batch that are answered one by one


class _Timeline:
    """An entity's applied events: sorted arrays with running sums, and recent additions beside them.

    It begins with times, amounts, names and others of the events that are there."""

    def __init__(self, events: tuple = ()):
        times, amounts, names, others = events or ((), (), (), ())
        self._take(np.asarray(times, "<i8"), np.asarray(amounts, "<i8"), np.array(names, dtype=object), np.array(others, dtype=object))

    def _take(self, times: np.ndarray, amounts: np.ndarray, names: np.ndarray, others: np.ndarray) -> None:
        order = np.argsort(times, kind="stable")
        self.times, self.amounts, self.names, self.others = times[order], amounts[order], names[order], others[order]
        self.sums = np.concatenate([[0], np.cumsum(self.amounts)])
        self.fresh: list[tuple] = []  # (time, name, amount, other), sorted

    def add(self, time: int, name: str, amount: int, other: str) -> None:
        insort(self.fresh, (time, name, amount, other))
        if len(self.fresh) >= _FRESH:
            new = list(zip(*self.fresh, strict=True))
            self._take(
                np.concatenate([self.times, np.array(new[0], "<i8")]), np.concatenate([self.amounts, np.array(new[2], "<i8")]),
                np.concatenate([self.names, np.array(new[1], dtype=object)]), np.concatenate([self.others, np.array(new[3], dtype=object)]),
            )

    def window(self, start: int, end: int, name: str) -> tuple[int, int]:
        """Number and amount of events in [start, end) other than the one named."""
        low, high = np.searchsorted(self.times, (start, end))
        recent = self.fresh[bisect_left(self.fresh, (start,)) : bisect_left(self.fresh, (end,))]
        n, total = int(high - low) + len(recent), int(self.sums[high] - self.sums[low]) + sum(r[2] for r in recent)
        own = [int(a) for a in self.amounts[low:high][self.names[low:high] == name]] + [r[2] for r in recent if r[1] == name]
        return n - len(own), total - sum(own)

    def newest(self, start: int, end: int, name: str) -> int | None:
        """Time of the last event in [start, end) other than the one named."""
        low, high = np.searchsorted(self.times, (start, end))
        at = int(high) - 1
        while at >= low and self.names[at] == name:
            at -= 1
        recent = [r[0] for r in self.fresh[bisect_left(self.fresh, (start,)) : bisect_left(self.fresh, (end,))] if r[1] != name]
        return max(recent[-1:] + ([int(self.times[at])] if at >= low else []), default=None)

    def met(self, start: int, end: int, name: str, other: str) -> bool:
        """Whether an event in [start, end) other than the one named was with `other`."""
        low, high = np.searchsorted(self.times, (start, end))
        if bool(((self.others[low:high] == other) & (self.names[low:high] != name)).any()):
            return True
        recent = self.fresh[bisect_left(self.fresh, (start,)) : bisect_left(self.fresh, (end,))]
        return any(r[3] == other and r[1] != name for r in recent)


class _Events:
    """Events of the entities of a group: arrays of times and amounts, lists of names, others and entities."""

    def __init__(self, days: list[tuple]):
        tables = [_table(d[1]) for d in days]

        def texts(name: str) -> list:
            return [x for t in tables for x in t[name].to_pylist()]

        empty = np.empty(0, "<i8")
        self.times = np.concatenate([empty, *(np.frombuffer(d[0], "<i8") for d in days)])
        self.amounts = np.concatenate([empty, *(t["amount"].to_numpy() for t in tables)])
        self.names, self.others, self.entities = texts("name"), texts("other"), texts("entity")


class _Together:
    """What the rows of a batch have seen of their own entities' events, counted for all of them at once.

    A row sees the events from before the batch and those that the batch applied no later than it arrived. Events are
    named by their rank in time; the few that carry a row's own id are taken out one by one."""

    def __init__(self, line: _Events, rows: dict[str, list], other: str):
        def column(name: str, of: list[int]) -> np.ndarray:
            values = rows[name]
            return np.array([values[i] for i in of], "<i8")

        every = list(range(len(rows["status"])))
        new = [i for i in every if rows["status"][i] == APPLIED]
        self.rows, self.at, self.until = rows, column("event_us", every), column("received_us", every)
        times = np.concatenate([line.times, column("event_us", new)])
        order = np.argsort(times, kind="stable")
        self.times, self.ranks = times[order], np.arange(order.size)
        self.arrived = np.concatenate([np.full(line.times.size, self.until.min()), column("received_us", new)])[order]
        self.amounts = np.concatenate([line.amounts, column("amount", new)])[order]

        def ranked(before: list, name: str) -> list:
            values = before + [rows[name][i] for i in new]
            return [values[i] for i in order.tolist()]

        self.names, self.others = ranked(line.names, "event_id"), ranked(line.others, "other")
        #: small numbers of the entities of the events and of the rows
        codes: dict[str | None, int] = {}
        self.points = np.array([codes.setdefault(x, len(codes)) for x in ranked(line.entities, "entity")], np.int64)
        self.groups = np.array([codes.setdefault(x, len(codes)) for x in rows["entity"]], np.int64)
        self.entities = max(len(codes), 1)
        named: dict[str, list[int]] = {name: [] for name in rows["event_id"]}
        for rank, name in enumerate(self.names):
            if name in named:
                named[name].append(rank)
        #: (row, rank) of events that a row must not count although it could see them
        self.own = [
            (i, rank) for i, name in enumerate(rows["event_id"]) for rank in named[name]
            if self.points[rank] == self.groups[i] and self.times[rank] < self.at[i] and self.arrived[rank] <= self.until[i]
        ]

    def _inside(self, widths: list[int], points: np.ndarray, groups: np.ndarray, same: Callable[[int, int], bool]) -> list[np.ndarray]:
        """Number and amount of the visible other events of a row's group in [t - width, t), for each width.

        `same` tells whether the event of a rank is of a row's group."""
        weights = np.stack([np.ones(self.times.size, np.int64), self.amounts])
        offsets = [0, *widths]
        places = np.concatenate([np.searchsorted(self.times, self.at - back) for back in offsets])
        many = len(offsets)
        before = count_visible(points, self.ranks, self.arrived, weights, self.ranks, np.tile(groups, many), places, np.tile(self.until, many))[0]
        upto, *starts = np.split(before, many, axis=1)
        out = []
        for width, start in zip(widths, starts, strict=True):
            found = upto - start
            for i, rank in self.own:
                if self.times[rank] >= self.at[i] - width and same(i, rank):
                    found[:, i] -= (1, self.amounts[rank])
            out.append(found)
        return out

    def windows(self, widths: list[int]) -> list[tuple[list[int], list[int]]]:
        """Number and amount of the other events in [t - width, t) of each row, for each width."""
        found = self._inside(widths, self.points, self.groups, lambda i, rank: True)
        return [(n.tolist(), total.tolist()) for n, total in found]

    def newest(self, width: int) -> list[int | None]:
        """Time of the last other event in [t - width, t) of each row."""
        out: list[int | None] = [None] * self.at.size
        places, left = np.searchsorted(self.times, self.at), np.arange(self.at.size)
        one = np.ones((1, self.times.size), np.int64)
        while left.size:
            last = count_visible(self.points, self.ranks, self.arrived, one, self.ranks, self.groups[left], places, self.until[left])[1]
            again = []
            for k, (i, rank) in enumerate(zip(left.tolist(), last.tolist(), strict=True)):
                if rank == NOTHING or self.times[rank] < self.at[i] - width:
                    continue
                if self.names[rank] == self.rows["event_id"][i]:
                    again.append(k)
                else:
                    out[i] = int(self.times[rank])
            left, places = left[again], last[again]
        return out

    def met(self, width: int) -> list[bool]:
        """Whether an other event in [t - width, t) of each row was with the same other."""
        codes: dict[str, int] = {}
        points = np.array([codes.setdefault(x, len(codes)) for x in self.others], np.int64)
        groups = np.array([codes.setdefault(x, len(codes)) for x in self.rows["other"]], np.int64)
        pairs = (points * self.entities + self.points, groups * self.entities + self.groups)
        return (self._inside([width], *pairs, lambda i, rank: self.others[rank] == self.rows["other"][i])[0][0] > 0).tolist()


class _Histories(StatefulProcessor):
    """Keyed by a group of entities: one state entry per day of their applied events, removed by a timer as the day passes.

    An entry holds the times, the other fields as a table, and the number of entities of the day. A processor that is
    not `grouped` is keyed by the entity itself and reads rows instead of packs."""

    of, other, added = "", "", ""

    def __init__(self, grouped: bool = False):
        self.grouped = grouped

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "times binary, events binary, kept long")

    def _extend(self, added: dict[int, list[tuple]], stored: dict[int, tuple]) -> None:
        """Add (time, name, amount, other, entity if they are grouped) to their days, of which those `stored` are known;
        a day that was stored has its timer."""
        for day, items in added.items():
            times, events, _ = stored.get(day) or (b"", b"", 0)
            _, names, amounts, others, *entities = zip(*items, strict=True)
            columns = [amounts, names, others, *(entities or [[None] * len(items)])]
            table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _DAY, strict=True)], _DAY)
            if times:
                table = pa.concat_tables([_table(events), table]).combine_chunks()
            kept = len(table["entity"].unique())
            self.days.updateValue((day,), (bytes(times) + np.array([i[0] for i in items], "<i8").tobytes(), _bytes(table, "zstd"), kept))
            if not times:
                self.handle.registerTimer((day + 1) * DAY // 1000)

    def _columns(self, rows: pa.Table) -> dict[str, list]:
        """What the answers need of the rows; they belong to one entity unless they are grouped."""
        out = {c: rows[c].to_pylist() for c in ("event_id", "event_us", "received_us", "status")}
        out["amount"] = [x or 0 for x in rows["amount_minor"].to_pylist()]
        out["other"] = [x or "" for x in rows[self.other].to_pylist()]
        out["entity"] = rows[self.of].to_pylist() if self.grouped else [None] * rows.num_rows
        return out

    def _one_by_one(self, events: _Events, rows: dict[str, list], horizon: int | None) -> list[tuple]:
        out: list[tuple] = [()] * len(rows["status"])
        for entity in dict.fromkeys(rows["entity"]):
            of = [i for i, x in enumerate(events.entities) if x == entity]
            line = _Timeline((events.times[of], events.amounts[of], [events.names[i] for i in of], [events.others[i] for i in of]))
            mine = [i for i, x in enumerate(rows["entity"]) if x == entity]
            # Rows that arrive in one microsecond see each other.
            for _, together in itertools.groupby(mine, rows["received_us"].__getitem__):
                waiting = list(together)
                for i in waiting:
                    if rows["status"][i] == APPLIED:
                        line.add(*(rows[c][i] for c in ("event_us", "event_id", "amount", "other")))
                for i in waiting:
                    out[i] = self.seen(line, {c: v[i] for c, v in rows.items()}, horizon)
        return out

    def _answered(self, table: pa.Table, horizon: int | None) -> pa.Table:
        """The rows of a batch, in order of arrival, with what they have seen; their applied events are added."""
        rows, stored = self._columns(table), {day: value for (day,), value in self.days.iterator()}
        # A day that has passed the horizon is not looked at, whether or not its timer has fired.
        events = _Events([v for day, v in stored.items() if horizon is None or (day + 1) * DAY > horizon])
        if table.num_rows <= _FEW:
            seen = list(zip(*self._one_by_one(events, rows, horizon), strict=True))
        else:
            seen = self.seen_by_all(_Together(events, rows, self.other), horizon)
        added: dict[int, list[tuple]] = {}
        fields = [rows[c] for c in ("event_us", "event_id", "amount", "other", *(["entity"] if self.grouped else []))]
        for status, item in zip(rows["status"], zip(*fields, strict=True), strict=True):
            if status == APPLIED:
                added.setdefault(item[0] // DAY, []).append(item)
        self._extend(added, stored)
        for field, column in zip(_arrow(self.added), seen, strict=True):
            table = table.append_column(field, pa.array(column, field.type))
        return table

    def handleInputRows(self, key, rows, timerValues):
        horizon = _horizon(timerValues)
        if self.grouped:
            yield _Pack(key[0], _bytes(self._answered(_arrived(rows), horizon)))
            return
        rows = sorted(rows, key=lambda r: (r["received_us"], r["seq"]))
        fields = _arrow("event_id string, event_us long, received_us long, status string, amount_minor long, customer_id string, terminal_id string")
        table = self._answered(pa.table({f.name: pa.array([r[f.name] for r in rows], f.type) for f in fields}), horizon)
        names = _names(self.added)
        for row, *found in zip(rows, *(table[name].to_pylist() for name in names), strict=True):
            yield Row(**row.asDict(), **dict(zip(names, found, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        gone = expiredTimerInfo.getExpiryTimeInMs() * 1000 // DAY - 1
        if self.days.containsKey((gone,)):
            self.days.removeKey((gone,))
        return iter([])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        events = _table(initialState["rows"])
        added: dict[int, list[tuple]] = {}
        for item in zip(*(events[c].to_pylist() for c in ("event_us", "event_id", "amount_minor", "other", "entity")), strict=True):
            added.setdefault(item[0] // DAY, []).append(item)
        self._extend(added, {day: self.days.getValue((day,)) for day in added})


class CustomerHistories(_Histories):
    of, other, added = "customer_id", "terminal_id", _CUSTOMER

    def seen(self, line: _Timeline, row: dict, horizon: int | None) -> tuple:
        t, own = row["event_us"], row["event_id"]
        found = {name: line.window(t - width, t, own) for name, width in CUSTOMER_WINDOWS.items()}
        counts = tuple(n for n, _ in found.values())
        previous = line.newest(t - MAX_WINDOW, t, own)
        return (horizon, *counts, found["7d"][1], found["30d"][1], previous, line.met(t - MAX_WINDOW, t, own, row["other"]))

    def seen_by_all(self, batch: _Together, horizon: int | None) -> list[list]:
        found = dict(zip(CUSTOMER_WINDOWS, batch.windows(list(CUSTOMER_WINDOWS.values())), strict=True))
        counts = [n for n, _ in found.values()]
        met = batch.met(MAX_WINDOW)
        return [[horizon] * len(met), *counts, found["7d"][1], found["30d"][1], batch.newest(MAX_WINDOW), met]


class TerminalHistories(_Histories):
    of, other, added = "terminal_id", "customer_id", _TERMINAL

    def seen(self, line: _Timeline, row: dict, horizon: int | None) -> tuple:
        t, own = row["event_us"], row["event_id"]
        return tuple(line.window(t - width, t, own)[0] for width in TERMINAL_WINDOWS.values())

    def seen_by_all(self, batch: _Together, horizon: int | None) -> list[list]:
        return [n for n, _ in batch.windows(list(TERMINAL_WINDOWS.values()))]


def _clocked(events: DataFrame, retention_us: int) -> DataFrame:
    """Rows with the event time that moves the watermark. A late row's clock is its arrival less the retention, so
    that it still reaches the operators and gets a status instead of being dropped."""
    clock = F.timestamp_micros(F.greatest("event_us", F.col("received_us") - lit(retention_us)))
    rows = events.withColumn("clock", clock).select(*_names(_EVENT))
    return rows.withWatermark("clock", f"{retention_us // 1000} milliseconds")


def _grouped(df: DataFrame, key: str, groups: int, packed: bool = False) -> DataFrame:
    """Packs of the rows of a frame, or of its packs, by the group of their key."""
    return df.mapInArrow(_packer(key, groups, packed), _PACK)


def _keyed(packs: DataFrame, processor: StatefulProcessor, initial: DataFrame | None) -> DataFrame:
    """`initial` are the packs that a group's state is made of; a group has few, as its rows lie in one task."""
    start = None if initial is None else initial.groupBy("group")
    return packs.groupBy("group").transformWithState(processor, _PACK, "Append", "EventTime", start)


def _initial(rows: DataFrame | None, key: str, groups: int) -> DataFrame | None:
    return None if rows is None else _grouped(rows.repartition(F.crc32(F.col(key).cast("binary")) % lit(groups)), key, groups)


def _statuses(events: DataFrame, retention_us: int, applied: DataFrame | None, groups: int) -> DataFrame:
    if retention_us < MAX_WINDOW:
        raise ValueError("retention_us is shorter than the longest window of the features")
    ids = sources = None
    if applied is not None:
        newest = F.max_by(F.struct("payload_hash", "source_id", "event_us"), F.struct("received_us", "seq"))
        ids = applied.groupBy("event_id").agg(newest.alias("r")).select("event_id", "r.*")
        owner = F.max_by(F.struct("event_id", "event_us"), F.struct("received_us", "seq"))
        sources = applied.groupBy(F.col("source_id").alias("claim")).agg(owner.alias("r")).select("claim", "r.*")
    packs = _grouped(_clocked(events, retention_us), "event_id", groups)
    claims = _keyed(packs, Identities(), _initial(ids, "event_id", groups))
    return _keyed(_grouped(claims, "claim", groups, packed=True), Owners(), _initial(sources, "claim", groups))


def keyed_statuses(events: DataFrame, retention_us: int = RETENTION, applied: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """Deliveries of a stream with their status; `applied` events (history of a bootstrap) are the state to start from.

    `groups` of keys are fixed when a query first starts, as its partitions are. A batch reads all living records of the
    groups that it mentions, so that some thousands of them in a group are a good number."""
    return _statuses(events, retention_us, applied, groups).mapInArrow(_unpack, _STATUS)


def keyed_features(events: DataFrame, retention_us: int = RETENTION, applied: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """Each delivery of a stream with its status, its features and `history_complete`.

    `applied` is a history that is handed over (its events are not decided again): the stream goes on as if it
    had read them itself. Null customers and terminals are keys like others; no rows give no rows. `groups` as in
    `keyed_statuses`."""
    seen, histories = _statuses(events, retention_us, applied, groups), None
    for key, other, processor in (("customer_id", "terminal_id", CustomerHistories), ("terminal_id", "customer_id", TerminalHistories)):
        if applied is not None:
            histories = applied.select(
                "event_us", "event_id", F.coalesce("amount_minor", lit(0)).alias("amount_minor"),
                F.coalesce(F.col(other), F.lit("")).alias("other"), F.col(key).alias("entity"),
            )
        seen = _keyed(_grouped(seen, key, groups, packed=True), processor(grouped=True), _initial(histories, "entity", groups))
    seen = seen.mapInArrow(_unpack, f"{_STATUS}, {_CUSTOMER}, {_TERMINAL}")
    count = F.col("cust_txn_count_30d")

    def mean(width: str) -> Column:
        n = F.col(f"cust_txn_count_{width}")
        return F.when(n > 0, F.col(f"cust_amount_{width}").cast("double") / n.cast("double"))

    mean_30d = mean("30d")
    out = seen.withColumns(
        {
            "decision_us": F.col("received_us"),
            "hour_of_day_utc": hour_of_day(F.col("event_us")),
            "day_of_week_utc": day_of_week(F.col("event_us")),
            "cust_amount_mean_7d": mean("7d"),
            "cust_amount_mean_30d": mean_30d,
            "amount_to_cust_mean_30d": F.when(mean_30d > 0, F.col("amount_minor").cast("double") / mean_30d),
            "secs_since_prev_cust_txn": (F.col("event_us") - F.col("previous_us")).cast("double") / F.lit(float(US)),
            "cust_has_history_30d": (count > 0).cast("bigint"),
            "cust_terminal_is_new_30d": F.when(F.col("pair_seen"), lit(0)).otherwise(lit(1)),
            "history_complete": F.coalesce(F.col("event_us") - lit(MAX_WINDOW) >= F.col("horizon_us"), F.lit(True)),
        }
    )
    return out.select("seq", "event_id", "customer_id", "terminal_id", "event_us", "decision_us", "status", *FEATURES, "history_complete")


def run_keyed(out: DataFrame, path: str, partitions: int | None = None) -> None:
    """Append a keyed stream to `path`/out until what is available has been read; its state lies in the checkpoint.

    `partitions` of the state are fixed when a query first starts; the session's shuffle partitions by default."""
    spark = out.sparkSession
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch uploads what it changed
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # counting would read before each write
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),  # rows of a batch are packs
    }
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = (
            out.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: What the operators of `keyed_features` keep; Spark numbers the operators of a query from its end.
KEPT = {3: ("ids", "record"), 2: ("sources", "owner"), 1: ("customer days", "days"), 0: ("terminal days", "days")}


def kept(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """(batch, kind, kept): records that `keyed_features` held after each of its first batches, from its checkpoint."""
    out = None
    for batch in range(batches):
        for operator, (kind, variable) in KEPT.items():
            reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
            entries = reader.option("batchId", batch).load(f"{path}/checkpoint")
            held = F.coalesce(F.sum(F.col("value" if operator > 1 else "user_map_value")["kept"]), lit(0))
            part = entries.agg(F.lit(batch).alias("batch"), F.lit(kind).alias("kind"), held.alias("kept"))
            out = part if out is None else out.unionByName(part)
    return out
