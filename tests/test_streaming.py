"""The micro-batch pipeline: state across batches, repeated batches, namespaces, dead letters."""

import json
from pathlib import Path

from pyspark.sql import functions as F
from test_apply import fold, stream
from test_decide import CASES

from tidegate import schemas
from tidegate.operators import apply as ap
from tidegate.operators.features import FEATURES, point_in_time
from tidegate.session import scratch, shared_dir
from tidegate.streaming.pipeline import Pipeline


def events(spark, rows):
    """Streams of test_apply as feature history."""
    full = [(seq, e, f"C{len(e) % 3}", f"T{t % 4}", t % 100, t, at, h, s) for seq, e, s, h, t, at in rows]
    return spark.createDataFrame(full, schemas.TXN_EVENT)


def test_batches_continue_the_sequential_result(spark):
    rows = sorted(stream(11, 60, n=120), key=lambda r: (r[5], r[0]))
    pipeline = Pipeline(spark, scratch(spark, "p"), with_features=False)
    for number, start in enumerate(range(0, len(rows), 60)):
        batch = events(spark, rows[start : start + 60])
        pipeline.on_events(batch, number)
        if number == 1:
            pipeline.on_events(batch, number)
    got = {r["seq"]: r["status"] for r in pipeline.table("statuses").collect()}
    want = fold(rows, ap.RETENTION)
    assert got == want and ap.LATE in want.values()
    refused = pipeline.table("refused").count()
    assert refused == sum(s in ap.DEAD_LETTER_STATUSES for s in want.values())


def test_features_of_batches_equal_the_whole(spark):
    rows = [r for r in stream(3, 20, n=80)]
    rows = sorted(((s, e, src, h, t, t + 1000) for s, e, src, h, t, _ in rows), key=lambda r: (r[5], r[0]))
    pipeline = Pipeline(spark, scratch(spark, "f"))
    for number, start in enumerate(range(0, len(rows), 60)):
        pipeline.on_events(events(spark, rows[start : start + 60]), number)
    whole = point_in_time(ap.apply_events(events(spark, rows)).checkpoint(), repeated_ids=True)
    columns = ["seq", *FEATURES]
    got = sorted(map(tuple, pipeline.table("features").select(*columns).collect()))
    assert got == sorted(map(tuple, whole.select(*columns).collect()))


def test_a_replay_leaves_live_state_alone(spark):
    base = scratch(spark, "ns")
    rows = events(spark, [(i, f"e{i}", f"e{i}", "h", i, i) for i in range(10)])
    live = Pipeline(spark, base, "live", with_features=False)
    replay = Pipeline(spark, base, "replay:r1", with_features=False)
    live.on_events(rows, 0)
    before = sorted(map(tuple, live.history(9).collect()))
    replay.on_events(rows, 0)
    assert replay.table("statuses").filter("status = 'applied'").count() == 10
    assert sorted(map(tuple, live.history(9).collect())) == before


def test_messages_go_to_history_or_to_dead_letters(spark):
    pipeline = Pipeline(spark, scratch(spark, "m"), with_features=False)
    inbox = pipeline.path("inbox")
    rows = [(k, v.encode() if v is not None else None, h, "t", 0, i) for i, (k, v, h, _) in enumerate(CASES)]
    spark.createDataFrame(rows, schemas.MESSAGE).write.parquet(inbox)
    for _ in range(2):
        pipeline.run(spark.readStream.schema(schemas.MESSAGE).parquet(inbox), pipeline.on_messages)
    statuses = {r["seq"]: r["status"] for r in pipeline.table("statuses").collect()}
    assert statuses == {0: "applied", 1: "duplicate", 2: "duplicate"}
    reasons = [r["reason"] for r in pipeline.table("dead_letters").collect()]
    assert sorted(reasons) == sorted(c[3] for c in CASES if c[3])
    # Nothing was read again by the second run, and the original bytes were kept.
    kept = pipeline.table("dead_letters").filter("reason = 'UNSUPPORTED_CURRENCY'").select(F.col("value").cast("string")).collect()
    assert {json.loads(r[0])["currency"] for r in kept} == {"EUR"}


def test_the_horizon_is_that_of_the_namespace(spark):
    """A batch of other customers has moved the watermark: an older event's window may be trimmed."""
    pipeline = Pipeline(spark, scratch(spark, "w"))
    day = 86_400_000_000
    ahead = [(i, f"a{i}", f"a{i}", "h", 40 * day + i, 40 * day + i) for i in range(3)]
    behind = [(10, "other", "other", "h", 35 * day, 40 * day + 10)]
    pipeline.on_events(events(spark, ahead), 0)
    pipeline.on_events(events(spark, behind).withColumn("customer_id", F.lit("B")), 1)
    got = {r["seq"]: r["history_complete"] for r in pipeline.table("features").collect()}
    assert got == {0: True, 1: True, 2: True, 10: False}


def test_offsets_of_two_partitions_are_two_messages(spark):
    pipeline = Pipeline(spark, scratch(spark, "p2"), with_features=False)
    value, headers = CASES[0][1], CASES[0][2]
    ids = [("buyer-5", 0, json.dumps({**json.loads(value), "event_id": f"11111111-2222-3333-4444-55555555555{p}"}).encode()) for p in range(2)]
    rows = [(k.encode(), v, [h for h in headers if h[0] != "event_id"], "t", p, o) for p, (k, o, v) in enumerate(ids)]
    pipeline.on_messages(spark.createDataFrame(rows, schemas.MESSAGE), 0)
    statuses = sorted(r["status"] for r in pipeline.table("statuses").collect())
    assert statuses == ["applied", "event_id_conflict"]
    kept = pipeline.table("dead_letters").collect()
    assert [(r["reason"], bytes(r["value"]) in {v for *_, v in ids}) for r in kept] == [("event_id_conflict", True)]


def test_an_attempt_without_commit_is_not_read(spark, monkeypatch):
    """An attempt ends between two writes; readers see the batches before, and the next attempt counts once."""
    pipeline = Pipeline(spark, scratch(spark, "c"), with_features=False)
    first = events(spark, [(i, f"e{i}", f"e{i}", "h", i, i) for i in range(5)])
    second = events(spark, [(10 + i, f"e{3 + i}", f"e{3 + i}", "h", 3 + i, 50 + i) for i in range(5)])
    pipeline.on_events(first, 0)
    put = Pipeline._put

    def stops(self, written, name, df, number, by=None):
        put(self, written, name, df, number, by)
        if name == "refused":
            raise RuntimeError("stopped")

    monkeypatch.setattr(Pipeline, "_put", stops)
    for _ in range(2):
        try:
            pipeline.on_events(second, 1)
        except RuntimeError:
            pass
        assert pipeline.table("statuses").count() == 5 and pipeline.history(2).count() == 5
    monkeypatch.setattr(Pipeline, "_put", put)
    for _ in range(2):
        pipeline.on_events(second, 1)
    statuses = [r["status"] for r in pipeline.table("statuses").collect()]
    assert sorted(statuses) == ["applied"] * 8 + ["duplicate"] * 2
    assert pipeline.snapshot().agg(F.sum("applied_count")).first()[0] == 8


def test_folders_behind_the_horizon_leave_the_history(spark):
    pipeline = Pipeline(spark, scratch(spark, "h"), with_features=False)
    day = 86_400_000_000
    for number in range(4):
        at = number * 20 * day
        pipeline.on_events(events(spark, [(10 * number + i, f"e{number}{i}", f"e{number}{i}", "h", at + i, at + i) for i in range(3)]), number)
    assert [len(pipeline.commit_of(n)["history"]) for n in range(4)] == [1, 2, 2, 2]
    assert {r["batch"] for r in pipeline.history(4).select("batch").distinct().collect()} == {2, 3}
    assert pipeline.table("statuses").count() == 12


def test_folded_snapshots_read_few_folders(spark):
    rows = sorted(stream(7, 40, n=120), key=lambda r: (r[5], r[0]))
    plain, folding = (Pipeline(spark, scratch(spark, "fold"), with_features=False, fold_after=n) for n in (1000, 3))
    for number, start in enumerate(range(0, len(rows), 20)):
        for pipeline in (plain, folding):
            pipeline.on_events(events(spark, rows[start : start + 20]), number)
        assert len(folding.commit_of(number)["entities"]) <= 3
    for at in (None, 3, number):
        a, b = (sorted(map(tuple, p.snapshot(at).collect())) for p in (plain, folding))
        assert a == b and a
    names = {t["name"] for n in range(number + 1) for t in folding.commit_of(n)["tables"]}
    assert "entities_folded" in names


def test_a_fold_without_a_commit_is_not_read(spark, monkeypatch):
    pipeline = Pipeline(spark, scratch(spark, "fold"), with_features=False, fold_after=1)
    rows = [(i, f"e{i}", f"e{i}", "h", i, i) for i in range(9)]
    pipeline.on_events(events(spark, rows[:3]), 0)
    before = sorted(map(tuple, pipeline.snapshot().collect()))
    put = Pipeline._put

    def fails(self, written, name, *rest):
        put(self, written, name, *rest)
        if name == "entities_folded":
            raise RuntimeError("lost")

    monkeypatch.setattr(Pipeline, "_put", fails)
    try:
        pipeline.on_events(events(spark, rows[3:6]), 1)
    except RuntimeError:
        pass
    assert sorted(map(tuple, pipeline.snapshot().collect())) == before
    monkeypatch.setattr(Pipeline, "_put", put)
    pipeline.on_events(events(spark, rows[3:6]), 1)
    assert pipeline.snapshot().agg(F.sum("applied_count")).first()[0] == 6


def test_commits_without_a_list_of_entities(spark):
    pipeline = Pipeline(spark, scratch(spark, "fold"), with_features=False, fold_after=2)
    rows = [(i, f"e{i}", f"e{i}", "h", i, i) for i in range(9)]
    pipeline.on_events(events(spark, rows[:3]), 0)
    old = pipeline._commits().drop("entities").checkpoint()
    old.coalesce(1).write.mode("overwrite").json(pipeline.path("commits/000000000"))
    assert pipeline.snapshot().agg(F.sum("applied_count")).first()[0] == 3
    pipeline.on_events(events(spark, rows[3:]), 1)
    assert len(pipeline.commit_of(1)["entities"]) == 2 and pipeline.snapshot().agg(F.sum("applied_count")).first()[0] == 9


def test_history_of_a_batch_moves_no_wide_rows(spark, tmp_path):
    """Rows of its ids, sources, customers and terminals; nulls match nothing; lists are broadcast."""
    from tidegate.sources.buckets import exchanges
    from tidegate.streaming.pipeline import Pipeline

    def frame(rows):
        return spark.createDataFrame([(i, e, c, t, 1, 5, 5, "h", s) for i, e, s, c, t in rows], schemas.TXN_EVENT)

    path = str(tmp_path / "history")
    frame([(0, "a", "a", "c1", "t1"), (1, "b", "s", "c2", "t2"), (2, "x", "x", "c3", None), (3, None, "y", None, "t4"), (4, "s", "z", "c1", "t9")]).write.parquet(path)
    history, rows = spark.read.parquet(path), frame([(9, "a", "s", "c1", "t4"), (8, None, "q", "c2", None)])
    found = Pipeline(spark, str(tmp_path))._identities(history, rows)
    assert sorted(r["seq"] for r in found.collect()) == [0, 1]
    mine = Pipeline._of_entities(history, rows, ["customer_id", "terminal_id"])
    assert exchanges(mine) == 2  # the two lists
    assert sorted(r["seq"] for r in mine.collect()) == [0, 1, 3, 4]


def test_texts_of_valid_messages_are_not_kept_again(spark):
    """A batch writes the fields of a valid message once; a refused one keeps its bytes, also when its status refuses it."""
    pipeline = Pipeline(spark, scratch(spark, "kept"), with_features=False)
    value, headers = CASES[0][1], [h for h in CASES[0][2] if h[0] != "event_id"]
    other = json.dumps({**json.loads(value), "event_id": "11111111-2222-3333-4444-555555555559"})
    rows = [(b"buyer-5", v.encode(), headers, "t", 0, o) for o, v in enumerate([value, other, value[:50]])]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("parsed-*/*.parquet"))
    pipeline.on_messages(spark.createDataFrame(rows, schemas.MESSAGE), 0)
    new = [str(p) for p in set(folder.glob("parsed-*/*.parquet")) - before]
    assert new and [bytes(r[0]) for r in spark.read.parquet(*new).select("value").filter("value is not null").collect()] == [value[:50].encode()]
    letters = {r["reason"]: bytes(r["value"]).decode() for r in pipeline.table("dead_letters").collect()}
    assert letters == {"event_id_conflict": other, "MALFORMED_JSON": value[:50]}
