"""Content-defined fingerprints against a rolling hash by hand, and edits against sorted neighbours."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidegate.llm import chunks, registry


def chunks_by_hand(data):
    """The cuts of one text, byte by byte."""
    out, start, h, marks = [], 0, 0, []
    for b in data:
        h = ((h << 1) + (int(chunks.GEAR[b]))) & 0xFFFFFFFF
        marks.append(h)
    while start < len(data):
        end = min(start + chunks.MOST, len(data))
        for at in range(start + chunks.LEAST, end):
            zeros = chunks.STRICT if at < start + chunks.USUAL + 1 else chunks.LOOSE
            if len(data) - start > chunks.LEAST and marks[at - 1] >> (32 - zeros) == 0:
                end = at
                break
        out.append((start, end))
        start = end
    return out


def test_cuts_equal_a_rolling_hash():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 60, 300, 4000):
        data = bytes(rng.choice(b"abc defgh\x00\xc3\xa9") for _ in range(n))
        want = {chunks.xxhash.xxh32_intdigest(data[s:e]): e - s for s, e in chunks_by_hand(data)}
        assert chunks.chunk_sets([b"other text before", data, b""])[1] == want


def test_chunks_resist_a_shift():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefghij ") for _ in range(20_000))
    a, b = chunks.chunk_sets([text, b"inserted " + text[:9000] + b"!" + text[9000:]])
    assert chunks.contained(a, b) > 0.97 and chunks.contained(a, a) == 1.0


def want_of(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (key, text) in enumerate(order):
        nxt, n = order[(i + 1) % len(order)][1], len(text)
        out[key] = (n, hashlib.sha256((text[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest(), nxt)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edits_meet_their_neighbours(spark, parts):
    rng = random.Random(3)
    rows = [(i * 7 - 300 if i else None, "".join(rng.choice("aé😀 \nxyz") for _ in range(rng.choice([0, 1, 40, 900])))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = chunks.edits(docs, parts=parts).collect()
    want = want_of(rows)
    assert len(got) == 90
    for r in got:
        n, digest, nxt = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        own, following = chunks.chunk_sets([dict(rows)[r["doc_id"]].encode(), nxt.encode()])
        assert r["fingerprint"] == chunks.written_out(own) and r["near_next"] == chunks.contained(own, following)


def test_query_and_containment_agree(spark, sf, docs):
    got = registry.op3_fingerprints(spark, sf)
    shares = got.select("near_edited", chunks.containment("fingerprint", "edited_fingerprint").alias("c")).collect()
    assert all(r["c"] == pytest.approx(r["near_edited"]) for r in shares)
    want = want_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = got.collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == {k: v[:2] for k, v in want.items()}
    near = [r["near_edited"] for r in rows if r["n_chars"] > 500]
    assert 0.4 < sum(near) / len(near) < 0.6
    plain = {r["doc_id"]: r["fingerprint"] for r in chunks.fingerprints(docs).collect()}
    assert plain == {r["doc_id"]: r["fingerprint"] for r in rows}


def test_odd_rows_and_single_rows(spark, odd, none):
    got = chunks.edits(odd).collect()
    assert len(got) == odd.count()
    assert all(r["fingerprint"] == "" and r["near_edited"] in (0.0, 1.0) for r in got if not r["n_chars"])
    assert chunks.edits(none).count() == 0
    one = chunks.edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert odd.where(F.col("doc_id") == 5).count() == 4


def placed(df, parts):
    place, number = chunks.ranges(df, parts)
    sizes = {r["place"]: r["count"] for r in df.groupBy(place.alias("place")).count().collect()}
    assert set(sizes) <= set(range(number))
    return sizes


@pytest.mark.parametrize("heavy", ["cast(null as long)", "7L"])
def test_heavy_and_null_keys_are_cut(spark, heavy):
    """100,000 rows, three quarters of them without a key or of one key."""
    df = spark.range(100_000).selectExpr(f"if(id % 4 = 0, id, {heavy}) AS key", "xxhash64(id) AS hash")
    assert max(placed(df, 16).values()) < 2 * 100_000 / 16


def test_edits_of_heavy_keys_follow_key_hash_and_text(spark):
    rows = [(None if i % 3 else i % 4, f"text {i} " * (i % 5)) for i in range(240)] + [(3, "again")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    have = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"]) for r in chunks.edits(df, parts=7).collect())
    hashed = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]], r[1]))
    want = []
    for (key, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((key is not None, key or 0, hashlib.sha256(edited.encode()).hexdigest()))
    assert have == sorted(want)
