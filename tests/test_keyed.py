"""Keyed streaming state against sequential readers."""

import random

import pytest
from pyspark.sql import functions as F

from tidegate import schemas
from tidegate.operators import apply as ap
from tidegate.session import scratch
from tidegate.streaming import keyed

DAY = 86_400_000_000
START = 1_700_000_000_000_000


def deliveries(seed, n, days):
    """Repeats, conflicts, stolen sources, expired ids and late events, in order of arrival."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        at = START + seq * days * DAY // n
        event = at - rng.choice([0, 5, DAY, 45 * DAY if rng.random() < 0.5 else 0])
        name = f"e{rng.randrange(n // 3)}"
        source = f"s{name}" if rng.random() < 0.85 else f"se{rng.randrange(n // 3)}"
        rows.append((seq, name, f"c{seq % 3}", f"t{seq % 4}", seq % 50, event, at, rng.choice("hhhg"), source))
    return rows


def model(batches, retention=ap.RETENTION):
    """The rules of the module, read one row after another; the horizon is that of the batches before."""
    ids, owners, out, newest = {}, {}, {}, None
    for batch in batches:
        horizon = None if newest is None else newest // 1000 * 1000 - retention
        for seq, name, _, _, _, event, at, payload, source in batch:
            known = ids.get(name)
            known = known if known and (horizon is None or known[2] >= horizon) else None
            if horizon is not None and event < horizon:
                out[seq] = ap.LATE
                continue
            new = known is None
            if new:
                known = ids[name] = (payload, source, event)
            held = owners.get(known[1])
            held = held if held and (horizon is None or held[1] >= horizon) else None
            if new and held is None:
                owners[source] = (name, event)
                out[seq] = ap.APPLIED
            elif held is None or held[0] != name:
                out[seq] = ap.EVENT_ID_CONFLICT
            elif new:
                out[seq] = ap.APPLIED
            elif known[0] != payload:
                out[seq] = ap.PAYLOAD_CONFLICT
            else:
                out[seq] = ap.DUPLICATE if known[1] == source else ap.EVENT_ID_CONFLICT
        tops = [max(r[5], r[6] - retention) for r in batch]
        newest = max([newest or 0, *tops])
    return out


def test_statuses_over_batches_and_a_restart(spark):
    rows = deliveries(4, 240, 80)
    batches = [rows[i : i + 60] for i in range(0, 240, 60)]
    path = scratch(spark, "keyed")
    for pair in (batches[:2], batches[2:]):
        for batch in pair:
            spark.createDataFrame(batch, schemas.TXN_EVENT).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schemas.TXN_EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        keyed.run_keyed(keyed.keyed_statuses(stream), path, 1)
    have = {r["seq"]: r["status"] for r in spark.read.parquet(f"{path}/out").collect()}
    want = model(batches)
    assert have == want and set(want.values()) == set(ap.STATUSES)
    # Records of events before the horizon are gone from the store.
    reader = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "record")
    left = reader.load(f"{path}/checkpoint").select(F.col("value.event_us").alias("at")).agg(F.min("at"), F.count("*")).first()
    newest = max(max(r[5], r[6] - ap.RETENTION) for r in rows)
    assert left[0] >= newest // 1000 * 1000 - ap.RETENTION and 0 < left[1] < len({r[1] for r in rows})


def test_no_rows(spark):
    path = scratch(spark, "none")
    spark.createDataFrame([], schemas.TXN_EVENT).write.parquet(f"{path}/in")
    keyed.run_keyed(keyed.keyed_features(spark.readStream.schema(schemas.TXN_EVENT).parquet(f"{path}/in")), path, 1)
    assert spark.read.schema("seq long").parquet(f"{path}/out").count() == 0


def test_a_short_retention_is_refused(spark):
    with pytest.raises(ValueError, match="retention"):
        keyed.keyed_statuses(spark.createDataFrame([], schemas.TXN_EVENT), 1)


@pytest.mark.parametrize("fresh", [3, 10_000])
def test_timelines_answer_as_lists_do(monkeypatch, fresh):
    monkeypatch.setattr(keyed, "_FRESH", fresh)
    rng = random.Random(fresh)
    line, items = keyed._Timeline([]), []
    for i in range(300):
        item = (rng.randrange(100), f"n{i // 2}", rng.randrange(9), f"o{rng.randrange(5)}")
        line.add(*item)
        items.append(item)
        start, name, other = rng.randrange(100), f"n{rng.randrange(150)}", f"o{rng.randrange(6)}"
        end = start + rng.randrange(40)
        inside = [x for x in items if start <= x[0] < end and x[1] != name]
        assert line.window(start, end, name) == (len(inside), sum(x[2] for x in inside))
        assert line.newest(start, end, name) == max((x[0] for x in inside), default=None)
        assert line.met(start, end, name, other) == any(x[3] == other for x in inside)


@pytest.mark.parametrize("few", [0, 10_000])
def test_rows_of_a_batch_see_the_same_together_as_one_by_one(monkeypatch, few):
    """Equal arrivals, own ids applied before, ties in event time and events older than a window."""
    monkeypatch.setattr(keyed, "_FEW", few)
    rng = random.Random(11)
    make = keyed.Row(*keyed._names(keyed._STATUS))
    stored = [(rng.randrange(40) * DAY, f"n{i % 60}", rng.randrange(9), f"t{rng.randrange(4)}") for i in range(90)]
    rows = []
    for seq in range(80):
        at, arrived = rng.choice([rng.randrange(40) * DAY, rng.randrange(20, 40) * DAY + 1]), 41 * DAY + rng.randrange(30)
        status = ap.APPLIED if rng.random() < 0.7 else ap.DUPLICATE
        rows.append(make(seq, f"n{rng.randrange(100)}", "c", f"t{rng.randrange(5)}", rng.randrange(9), at, arrived, "h", "s", None, status))

    class Days:
        held = {}

        def iterator(self):
            return iter([((d,), v) for d, v in self.held.items()])

        def updateValue(self, key, value):
            self.held[key[0]] = value

    class Timers:
        set = []

        def registerTimer(self, at):
            self.set.append(at)

        def getCurrentWatermarkInMs(self):
            return 0

    histories = keyed.CustomerHistories()
    histories.days, histories.handle = Days(), Timers()
    by_day = {}
    for item in stored:
        by_day.setdefault(item[0] // DAY, []).append(item)
    histories._extend(by_day, {})
    before = len(Timers.set)
    got = {r["seq"]: r for r in histories.handleInputRows(("c",), iter(rows), Timers())}
    for r in rows:
        new = [(x["event_us"], x["event_id"], x["amount_minor"], x["terminal_id"]) for x in rows if x["status"] == ap.APPLIED and x["received_us"] <= r["received_us"]]
        seen = [x for x in stored + new if x[0] < r["event_us"] and x[1] != r["event_id"]]
        month = [x for x in seen if x[0] >= r["event_us"] - 30 * DAY]
        week = [x for x in seen if x[0] >= r["event_us"] - 7 * DAY]
        have = got[r["seq"]]
        assert (have["cust_txn_count_30d"], have["cust_amount_30d"]) == (len(month), sum(x[2] for x in month))
        assert (have["cust_txn_count_7d"], have["cust_amount_7d"]) == (len(week), sum(x[2] for x in week))
        assert have["previous_us"] == max((x[0] for x in month), default=None)
        assert have["pair_seen"] == any(x[3] == r["terminal_id"] for x in month)
    # All applied events are kept, and a day has one timer.
    assert sum(len(v[0]) // 8 for v in Days.held.values()) == len(stored) + sum(r["status"] == ap.APPLIED for r in rows)
    assert len(Timers.set) == len(set(Timers.set)) == len(Days.held) >= before
    Days.held.clear(), Timers.set.clear()


class Store:
    """State variables of one group, and the exchanges with them."""

    def __init__(self, newest_us=0):
        self.calls, self.timers, self.values, self.newest_us = 0, set(), {}, newest_us

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, keys, values):
        return self

    def getCurrentWatermarkInMs(self):
        return self.newest_us // 1000

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def get(self):
        self.calls += 1
        return self.values.get(())

    def update(self, value):
        self.calls += 1
        self.values[()] = value

    def clear(self):
        self.values.clear()

    def getValue(self, key):
        return self.values.get(key)

    def iterator(self):
        self.calls += 1
        return iter(list(self.values.items()))

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value


def packs(rows, schema, pieces=3):
    fields = keyed._arrow(schema)
    for i in range(pieces):
        part = rows[i::pieces]
        if part:
            yield keyed._Pack(0, keyed._bytes(keyed.pa.table([keyed.pa.array(c, f.type) for c, f in zip(zip(*part), fields)], fields)))


def unpacked(answers):
    return [row for a in answers for row in keyed._table(a["rows"]).to_pylist()]


def test_many_ids_take_few_exchanges_with_the_state():
    rows = [(*r, None) for r in deliveries(5, 900, 80)]
    for operator, schema in ((keyed.Identities(), keyed._EVENT), (keyed.Owners(), f"{keyed._EVENT}, opinion string, claim string")):
        store, found = Store(), []
        operator.init(store)
        for batch in (rows[:450], rows[450:]):
            found += unpacked(operator.handleInputRows((0,), packs(batch, schema), store))
        assert store.calls <= 8 and len(found) == 900  # four for each batch, however many ids it has
        held = store.values[()]
        times = keyed._table(held[2])["event_us"].to_pylist()
        assert (min(times), len(times)) == held[:2] and held[0] // 1000 + 1 in store.timers
        # The timer leaves the records that the watermark has not passed, and sets the next one.
        store.newest_us = sorted(times)[len(times) // 2] + 1_000
        operator.handleExpiredTimer((0,), store, None)
        left = keyed._table(store.values[()][2])["event_us"].to_pylist()
        assert sorted(left) == sorted(t for t in times if t // 1000 + 1 > store.newest_us // 1000)
        assert 0 < len(left) < len(times) and min(left) // 1000 + 1 in store.timers
        rows = sorted(tuple(r.values()) for r in found)


@pytest.mark.parametrize("few", [0, 10_000])
def test_entities_of_a_group_see_their_own_events(monkeypatch, few):
    """Two batches of customers, one of them null, whose ids and terminals hold any character."""
    monkeypatch.setattr(keyed, "_FEW", few)
    rng = random.Random(few)
    customers = ["a", "b\x1fc", "", None, "ü"]
    rows = []
    for seq in range(240):
        arrived = 50 * DAY + seq // 3 * DAY // 20
        status = ap.APPLIED if rng.random() < 0.7 else ap.DUPLICATE
        at = arrived - rng.choice([0, 1, rng.randrange(30) * DAY])
        rows.append((seq, f"n\x1f{rng.randrange(150)}", rng.choice(customers), f"t\x1f{rng.randrange(5)}", rng.choice([None, 3, 8]), at, arrived, "h", "s", None, status))
    store, histories = Store(), keyed.CustomerHistories(grouped=True)
    histories.init(store)
    names, got = keyed._names(keyed._STATUS), {}
    for batch in (rows[:120], rows[120:]):
        got |= {r["seq"]: r for r in unpacked(histories.handleInputRows((0,), packs(batch, keyed._STATUS), store))}
    every = [dict(zip(names, r)) for r in rows]
    for r in every:
        earlier = [x for x in every if x["customer_id"] == r["customer_id"] and x["status"] == ap.APPLIED and x["received_us"] <= r["received_us"]]
        month = [x for x in earlier if r["event_us"] - 30 * DAY <= x["event_us"] < r["event_us"] and x["event_id"] != r["event_id"]]
        have = got[r["seq"]]
        assert (have["cust_txn_count_30d"], have["cust_amount_30d"]) == (len(month), sum(x["amount_minor"] or 0 for x in month))
        assert have["previous_us"] == max((x["event_us"] for x in month), default=None)
        assert have["pair_seen"] == any(x["terminal_id"] == r["terminal_id"] for x in month)
    days = {(x["customer_id"], x["event_us"] // DAY) for x in every if x["status"] == ap.APPLIED}
    assert sum(v[2] for v in store.values.values()) == len(days) and len(store.timers) == len({d for _, d in days})


def test_rows_are_dealt_to_the_groups_of_their_key():
    table = keyed.pa.table({"k": [None, *(f"k{i % 40}" for i in range(999))], "v": list(range(1000))})
    dealt = list(keyed._packer("k", 8, packed=False)(iter(table.to_batches(100))))
    again = list(keyed._packer("k", 3, packed=True)(iter(dealt)))
    for batches, groups in ((dealt, 8), (again, 3)):
        found = [(g, row) for b in batches for g, p in zip(b["group"].to_pylist(), b["rows"].to_pylist()) for row in keyed._table(p).to_pylist()]
        assert sorted(row["v"] for _, row in found) == list(range(1000))
        assert len({(row["k"], g) for g, row in found}) == 41 and 1 < len({g for g, _ in found}) <= groups
    assert sorted(v for b in keyed._unpack(iter(again)) for v in b["v"].to_pylist()) == list(range(1000))
    assert list(keyed._packer("k", 3, packed=False)(iter([]))) == [] == list(keyed._unpack(iter([])))
