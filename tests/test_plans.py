"""The shared plan shapes against brute force, with chunks far smaller than the data."""

import weakref

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tidegate.plans.ordered import chunked, framed, last_before, row_numbers, running
from tidegate.plans.quantiles import exact_percentiles
from tidegate.plans import visibility
from tidegate.plans.visibility import NOTHING, Scan, count_visible


def test_visible_counts_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, q, groups = (int(x) for x in (rng.integers(1, 60), rng.integers(1, 60), rng.integers(1, 4)))
        pg, pu = rng.integers(0, groups, n), rng.integers(0, 30, n)
        pv = pu + rng.integers(-3, 25, n) * (rng.random(n) < 0.4)
        w = np.stack([np.ones(n, int), rng.integers(0, 100, n)])
        qg, qx, qy = rng.integers(0, groups + 1, q), rng.integers(-5, 40, q), rng.integers(-5, 60, q)
        total, newest = count_visible(pg, pu, pv, w, pu, qg, qx, qy)
        for i in range(q):
            m = (pg == qg[i]) & (pu < qx[i]) & (pv <= qy[i])
            assert total[0, i] == m.sum() and total[1, i] == w[1][m].sum()
            assert newest[i] == (pu[m].max() if m.any() else NOTHING)


def test_a_task_answers_few_rows_at_once(monkeypatch):
    """However many rows a task has; those of an entity stay together, and a large one is asked slot by slot."""
    rng = np.random.default_rng(5)
    keys = np.repeat(np.arange(41), [10] * 40 + [300])
    n = keys.size
    u = rng.integers(0, 50, n)
    rows = dict(id=np.arange(n), k=keys, _u=u, _v=u + rng.integers(0, 9, n), _y=u + 3, later=u + 6, _w=np.ones(n, int), _point=np.ones(n, bool), _entity=keys)
    asked, real = [], visibility.count_visible
    monkeypatch.setattr(visibility, "count_visible", lambda *a: asked.append((a[0].size, a[5].size)) or real(*a))
    monkeypatch.setattr(visibility, "ASKED_AT_ONCE", 100)
    scan = Scan("c", ("k",), (("now", 0), ("back", 5), ("later", 0)), sums=("back",), last=("now",), until=(("later", "later"),))
    batches = pa.table(rows).to_batches(max_chunksize=7)
    out = pa.Table.from_batches(visibility._unit([scan], ["id", *scan.columns()], 30)(iter(batches))).to_pydict()
    assert out["id"] == list(range(n)) and len(asked) > 10
    assert max(q for p, q in asked if p < 300) <= 100 and max(p for p, _ in asked) <= 337
    for i in range(n):
        mine = (keys == keys[i]) & (rows["_v"] <= rows["_y"][i])
        assert out["c_n_now"][i] == (mine & (u < u[i])).sum() and out["c_s_back"][i] == (mine & (u < u[i] - 5)).sum()
        assert out["c_n_later"][i] == ((keys == keys[i]) & (u < u[i]) & (rows["_v"] <= u[i] + 6)).sum()


def test_a_task_lets_go_of_an_entity_before_it_reads_on():
    """The rows of an answered entity are not held beside those of the next one; only its last batch is."""
    firsts, alive = [], []

    def entities():
        for k in range(5):
            alive.append([i for i, ref in enumerate(firsts) if ref() is not None])
            u = np.arange(200)
            rows = dict(k=np.full(200, k), _u=u, _v=u + 1, _y=u + 3, _w=np.ones(200, int), _point=np.ones(200, bool), _entity=np.full(200, k))
            parts = [{name: values[at : at + 100].copy() for name, values in rows.items()} for at in (0, 100)]
            firsts.append(weakref.ref(parts[0]["_u"]))
            del u, rows
            while parts:
                yield pa.RecordBatch.from_pydict(parts.pop(0))

    scan = Scan("c", ("k",), (("now", 0),))
    assert sum(b.num_rows for b in visibility._unit([scan], ["k", "_u", "c_n_now"], 200)(entities())) == 1000
    # An entity is known to be whole when the next one's first batch comes; its own is gone when more is read.
    assert alive == [[], [0], [1], [2], [3]]


def test_wide_values_do_not_overflow():
    far = np.array([-(2**61), 0, 2**61])
    total, _ = count_visible(
        np.zeros(3, int), far, far, np.ones((1, 3), int), far, np.arange(5) % 2, np.full(5, 2**61), np.full(5, 2**61)
    )
    assert total[0].tolist() == [2, 0, 2, 0, 2]


def heavy_frame(spark, n=900):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(
        dict(
            id=np.arange(n),
            a=np.where(rng.random(n) < 0.4, 7, rng.integers(0, 50, n)),
            b=np.where(rng.random(n) < 0.5, 3, rng.integers(0, 1000, n)),
            k=np.where(rng.random(n) < 0.4, "hot", "x"),
        )
    )
    return pdf, spark.createDataFrame(pdf).checkpoint()


def test_chunks_are_small_and_follow_the_order(spark):
    pdf, df = heavy_frame(spark)
    chunks = chunked(df, [F.col("a"), F.col("b"), F.col("id")], 60)
    got = chunks.df.toPandas().sort_values(["a", "b", "id"])
    assert not chunks.single and got["_chunk"].is_monotonic_increasing
    assert got.groupby("_chunk").size().max() <= 180


def test_row_numbers_with_heavy_values(spark):
    pdf, df = heavy_frame(spark)
    got = row_numbers(df, [-F.col("a"), F.col("b"), F.col("id")], name="r", rows_per_chunk=60).toPandas()
    want = pdf.sort_values(["a", "b", "id"], ascending=[False, True, True]).id.tolist()
    assert got.sort_values("r").id.tolist() == want and sorted(got.r) == list(range(1, len(pdf) + 1))


def test_running_per_key_over_chunks(spark):
    pdf, df = heavy_frame(spark)
    chunks = chunked(df, [F.col("id")], 60)
    got = running(chunks, [F.col("id")], {"s": ("sum", F.col("a")), "m": ("max", F.col("b"))}, keys=["k"], inclusive=False)
    got = got.toPandas().sort_values("id").reset_index(drop=True)
    before = pdf.groupby("k").a.cumsum() - pdf.a
    first = ~pdf.duplicated("k")
    assert got.s.isna().tolist() == first.tolist()
    assert (got.s.fillna(0) == before).all()
    highest = pdf.groupby("k").b.transform(lambda x: x.cummax().shift())
    assert ((got.m == highest) | (got.m.isna() & highest.isna())).all()


def test_last_before_over_chunks(spark):
    pdf, df = heavy_frame(spark)
    chunks = chunked(df, [F.col("id")], 60)
    got = last_before(chunks, ["id"], ["k"], F.col("a") == 7, F.struct("id"), "seen").select("id", "seen.id").toPandas()
    got.columns = ["id", "seen"]
    got = got.sort_values("id").reset_index(drop=True)
    marked = pdf.id.where(pdf.a == 7)
    want = marked.groupby(pdf.k).transform(lambda x: x.ffill().shift())
    assert ((got.seen == want) | (got.seen.isna() & want.isna())).all()


def test_exact_percentiles_over_chunks(spark):
    pdf, df = heavy_frame(spark)
    got = exact_percentiles(df, F.col("b"), (0.0, 0.5, 0.95, 1.0), ["k"], rows_per_chunk=60).toPandas().set_index("k")
    for key, part in pdf.groupby("k"):
        assert np.allclose(got.loc[key, ["q0", "q1", "q2", "q3"]].astype(float), np.percentile(part.b, [0, 50, 95, 100]))
        assert got.loc[key, "rows"] == len(part)


def test_framed_slices_hold_whole_frames(spark):
    df = spark.range(100).select((F.col("id") * 7).alias("t"))
    rows = framed(df, [], "t", 50).toPandas()
    for t in range(0, 700, 7):
        mine = rows[(rows.t == t) & rows._own]
        assert len(mine) == 1
        inside = set(rows[rows["_slice"] == mine["_slice"].iloc[0]].t)
        assert {x for x in range(0, 700, 7) if t - 50 <= x <= t} <= inside


def test_chunks_beyond_one_cut_are_cut_again(spark, monkeypatch):
    from tidegate.plans import ordered

    monkeypatch.setattr(ordered, "MAX_CHUNKS", 3)
    rng = np.random.default_rng(5)
    values = np.where(rng.random(400) < 0.4, 7, rng.integers(0, 60, 400))
    rows = spark.createDataFrame(pd.DataFrame(dict(position=range(400), v=values)))
    chunks = ordered.chunked(rows, [F.col("v"), F.col("position")], 10)
    sizes = chunks.df.groupBy(chunks.column).count().toPandas()
    assert sizes["count"].max() <= 20
    got = ordered.row_numbers(rows, [F.col("v"), F.col("position")], rows_per_chunk=10).toPandas().sort_values("position")
    order = np.lexsort((np.arange(400), values))
    want = np.empty(400, int)
    want[order] = np.arange(1, 401)
    assert (got["rank"].to_numpy() == want).all()


def test_keys_smaller_than_a_chunk_are_read_without_cuts(spark):
    from tidegate.sources.buckets import exchanges

    _, df = heavy_frame(spark)
    df = df.withColumn("j", F.col("id") % 30)
    chunks = chunked(df, [F.col("id")], 60)
    cut, whole = (last_before(chunks, ["id"], ["j"], F.col("a") == 7, F.struct("id"), "seen", small) for small in (False, True))
    assert exchanges(whole) == 1 < exchanges(cut)
    rows = [{r["id"]: r["seen"] and r["seen"]["id"] for r in out.collect()} for out in (cut, whole)]
    assert rows[0] == rows[1] and len(rows[0]) == 900
