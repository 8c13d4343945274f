"""Statuses of seeded delivery streams against a sequential fold written from the rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidegate.functions.times import DAY
from tidegate.operators import apply as ap

COLUMNS = "seq long, event_id string, source_id string, payload_hash string, event_us long, received_us long"


def fold(rows, retention):
    """One delivery after the other, in arrival order."""
    watermark, records, owners, out = None, {}, {}, {}
    for seq, event, source, payload, t, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        horizon = None if watermark is None else watermark - retention

        def alive(event_id):
            record = records.get(event_id)
            return record is not None and (horizon is None or record[0] >= horizon)

        if horizon is not None and t < horizon:
            out[seq] = ap.LATE
        elif alive(event) and records[event][1] != payload:
            out[seq] = ap.PAYLOAD_CONFLICT
        elif alive(event) and records[event][2] != source:
            out[seq] = ap.EVENT_ID_CONFLICT
        elif alive(event):
            out[seq] = ap.DUPLICATE
        elif owners.get(source, event) != event and alive(owners[source]) and records[owners[source]][2] == source:
            out[seq] = ap.EVENT_ID_CONFLICT
        else:
            out[seq] = ap.APPLIED
            records[event] = (t, payload, source)
            owners[source] = event
            watermark = t if watermark is None else max(watermark, t)
    return out


def stream(seed, days, n=250):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append([f"e{i}", f"e{i}", "h0", rng.randrange(days * DAY)])
    for _ in range(30):
        rows.append(list(rng.choice(rows[:n])))
    for _ in range(10):
        row = list(rng.choice(rows[:n]))
        rows.append([row[0], row[1], "h1", row[3]])
    for _ in range(8):
        row = list(rng.choice(rows[:n]))
        rows.append([row[0], "s" + row[1], row[2], row[3]])
        other = list(rng.choice(rows[:n]))
        rows.append(["x" + other[0], other[1], other[2], rng.randrange(days * DAY)])
    rng.shuffle(rows)
    return [(i, e, s, h, t, i // 3) for i, (e, s, h, t) in enumerate(rows)]


@pytest.mark.parametrize("seed,days,chunk", [(1, 45, 10**6), (2, 60, 10**6), (3, 90, 60), (4, 120, 10**6)])
def test_equals_the_sequential_reader(spark, seed, days, chunk):
    rows = stream(seed, days)
    got = ap.apply_events(spark.createDataFrame(rows, COLUMNS), rows_per_chunk=chunk)
    assert {r["seq"]: r["status"] for r in got.collect()} == fold(rows, ap.RETENTION)


def test_every_status_occurs(spark):
    seen = set()
    for seed in range(1, 5):
        seen |= set(fold(stream(seed, 90), ap.RETENTION).values())
    assert seen == set(ap.STATUSES)


def test_exactly_at_the_horizon_is_accepted(spark):
    rows = [(0, "a", "a", "h", 40 * DAY, 0), (1, "b", "b", "h", 9 * DAY, 1), (2, "c", "c", "h", 9 * DAY - 1, 2)]
    got = ap.apply_events(spark.createDataFrame(rows, COLUMNS))
    assert [r["status"] for r in got.orderBy("seq").collect()] == [ap.APPLIED, ap.APPLIED, ap.LATE]


def test_one_id_with_a_third_of_all_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"e{i}", "hot" if i % 3 == 0 else f"e{i}", "h", 5, i) for i in range(600)]
    got = ap.apply_events(spark.createDataFrame(rows, COLUMNS), rows_per_chunk=50)
    counts = {r["status"]: r["n"] for r in ap.status_counts(got).collect()}
    assert counts == {ap.APPLIED: 401, ap.DUPLICATE: 199}
    assert got.filter(F.col("event_id") == "hot").filter("status = 'applied'").first()["seq"] == 0


def test_history_before_the_horizon_can_be_left_out(spark):
    """Loading [cutoff - retention - one day, cutoff) leaves the state that the whole history leaves."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        t = rng.randrange(80 * DAY)
        rows.append((i, f"e{i}", f"e{i}", "h", t, t + rng.randrange(DAY // 2)))
    cutoff = 75 * DAY
    whole = spark.createDataFrame([r for r in rows if r[5] < cutoff], COLUMNS)
    recent = whole.filter(F.col("received_us") >= cutoff - ap.RETENTION - DAY)
    kept = [
        {r["event_id"] for r in ap.retained(ap.apply_events(df).checkpoint(), cutoff).collect()} for df in (whole, recent)
    ]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < whole.count()


def test_earlier_watermark_is_taken_over(spark):
    rows = [(0, "a", "a", "h", 5 * DAY, 0), (1, "b", "b", "h", 20 * DAY, 1)]
    got = ap.apply_events(spark.createDataFrame(rows, COLUMNS), watermark_us=40 * DAY)
    assert [r["status"] for r in got.orderBy("seq").collect()] == [ap.LATE, ap.APPLIED]


def test_metadata_names_the_last_applied_event(spark):
    rows = [(0, "a", "a", "h", 5, 10), (1, "b", "b", "h", 3, 20), (2, "a", "a", "h", 5, 30)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("customer_id", F.lit("C"))
    got = ap.entity_metadata(ap.apply_events(df), "customer_id").first()
    assert tuple(got) == ("C", 2, 20, "b")


def test_long_chains_need_few_rounds(spark, monkeypatch):
    """Each delivery shares its id or its source with the one before, whose status decides its own."""
    rows = []
    for i in range(400):
        rows += [(2 * i, f"e{i}", f"s{i}", "h", 1000 + i, i), (2 * i + 1, f"e{i + 1}", f"s{i}", "h", 1000 + i, i)]
    rows += [(5000 + i, "hot", f"s{i % 3}", "h", 1000, 900 + i) for i in range(50)]
    rounds, status = [], ap._status
    monkeypatch.setattr(ap, "_status", lambda horizon: rounds.append(1) or status(horizon))
    got = {r["seq"]: r["status"] for r in ap.apply_events(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == fold(rows, ap.RETENTION) and len(rounds) <= 9


@pytest.mark.parametrize("seed,days,limit", [(1, 20, 100_000), (2, 100, 100_000), (3, 60, 90)])
def test_dense_chains_equal_the_sequential_reader(spark, monkeypatch, seed, days, limit):
    """Ids and sources drawn from a few, with repeats, over more than the horizon; long chains in several reads."""
    monkeypatch.setattr(ap, "CHAIN_ROWS", limit)
    rng = random.Random(seed)
    rows = []
    for i in range(220):
        event, source = f"e{rng.randrange(25)}", f"s{rng.randrange(25)}"
        rows.append((i, event, source, rng.choice("aab"), max(0, i * days * DAY // 220 - rng.choice([0, 0, 40 * DAY])), i // 2))
        if rng.random() < 0.3:
            rows.append((1000 + i, *rng.choice(rows)[1:5], i // 2))
    got = {r["seq"]: r["status"] for r in ap.apply_events(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == fold(rows, ap.RETENTION)


def test_repeats_of_a_hot_id_are_not_read_with_its_chain(spark, monkeypatch):
    """A chain that moves, and twenty thousand repeats of its last id: the group holds the chain alone."""
    sizes = []
    reader = ap._reader
    path = []

    def measured(retention):
        read = reader(retention)

        def count(rows):
            assert len(rows) <= 300, len(rows)
            return read(rows)

        path.append(1)
        return count

    monkeypatch.setattr(ap, "_reader", measured)
    links = [(2 * i + k, f"e{i + k}", f"s{i}", "h", 1000 + i, i) for i in range(120) for k in (0, 1)]
    many = spark.range(20_000).selectExpr("id + 1000 AS seq", "'e120' AS event_id", "'s119' AS source_id", "'h' AS payload_hash", "1119L AS event_us", "id + 500 AS received_us")
    got = ap.apply_events(spark.createDataFrame(links, COLUMNS).unionByName(many)).checkpoint()
    want = fold(links + [(1000, "e120", "s119", "h", 1119, 500), (1001, "e120", "s119", "h", 1119, 501)], ap.RETENTION)
    have = {r["seq"]: r["status"] for r in got.filter("seq < 1002").collect()}
    assert have == want and path and not sizes
    assert got.filter("seq > 1000").select("status").distinct().collect() == [(want[1001],)]


def test_payloads_are_equal_as_texts_are(spark):
    """Any text may be a payload hash; digits in lower case are kept in half the room."""
    texts = ["ab", "AB", "ab\n", "abc", "", "hab", "tab", "«", "0" * 64, "h", None, None]
    rows = [(i, f"e{i // 2}", f"s{i // 2}", x, DAY, DAY + i) for i, x in enumerate(y for a in texts for b in texts for y in (a, b))]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["seq"]: r["status"] for r in ap.apply_events(df).collect()}
    want = {i: ap.APPLIED if i % 2 == 0 else ap.DUPLICATE if rows[i][3] is None or rows[i - 1][3] in (None, rows[i][3]) else ap.PAYLOAD_CONFLICT for i in range(len(rows))}
    assert got == want
    short = df.select(F.length(ap._short("payload_hash")).alias("n")).filter(F.col("payload_hash") == "0" * 64).distinct().collect()
    assert [r["n"] for r in short] == [33]
