"""Token counts, id matrices and tiered packing against the library that the vocabulary file belongs to."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegate.llm import bpe, packing, pretokens, registry, tiers

PATH = registry.vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def strange(seed, n, most=25):
    rng = random.Random(seed)
    alphabet = ["a", "Z", "é", "1", "٣", " ", "   ", "\n", "\t", " ", "'", "'s", "'re", "ll", "!", "😀", "<|endoftext|>", "\x1c", "ß", "Ᲊ", "th", "\r\n"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_pretokens_equal_the_librarys(library, monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNK", 500)
    words = pretokens.Vocabulary(bpe.content_of(PATH))
    texts = strange(1, 3000) + strange(2, 5, 4000)
    got = [[] for _ in texts]
    for owners, parts in pretokens.pieces(texts, None):
        points, starts, ends, part = pretokens.split(parts, words)
        for s, e, p in zip(starts, ends, part):
            got[owners[p]].append(points[s:e].tobytes().decode("utf-32-le"))
    for text, parts in zip(texts, got):
        assert parts == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_heap_merging_equals_the_library(library):
    texts = strange(3, 2000) + ["ab" * 5000, "a" * 999, "<|endoftext|>" * 3]
    want = [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert bpe.Counter(bpe.content_of(PATH)).counts(texts).tolist() == want


def test_a_full_table_starts_anew(library):
    counter = bpe.Counter(bpe.content_of(PATH))
    counter.table = pretokens.Table(50)
    texts = strange(4, 800)
    for i in range(0, 800, 100):
        want = [len(e) for e in library.encode_batch_fast(texts[i : i + 100], add_special_tokens=False)]
        assert counter.counts(texts[i : i + 100]).tolist() == want


def test_query_counts_every_document(spark, sf, docs, library):
    got = {r["doc_id"]: r for r in registry.op2_token_counts(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r["text"], add_special_tokens=False))
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["over_limit"]) == (n, len(r["text"].encode()), n > 512)


def test_counts_of_odd_rows(odd, none, library):
    got = sorted(tuple(r) for r in bpe.token_counts(odd, PATH).na.fill(-1, ["doc_id"]).collect())
    want = []
    for r in odd.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False))
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(text.encode()), n, n > 512))
    assert got == sorted(want)
    assert bpe.token_counts(none, PATH).count() == 0


def ids_of(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def pieces_of(rows, start, ids):
    """Documents put together again from their pieces; a key may stand on several rows."""
    found = {}
    for key, at, part in sorted(((r[0] if r[0] is not None else -1), r[start], tuple(r[ids])) for r in rows):
        found.setdefault(key, []).append((at, part))
    return found


def test_matrices_hold_every_id_once(odd, none, library):
    packed = packing.pack_ids(odd, PATH, window=64, group=5000).checkpoint()
    rows = packed.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        ids, places = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4")
        assert len(ids) == len(places) == 64 and r["segment_ends"][-1] == r["n_tokens"] <= 64
        begins = [0, *r["segment_ends"][:-1]]
        for a, b in zip(begins, r["segment_ends"]):
            assert places[a:b].tolist() == list(range(b - a))
        assert (ids[r["n_tokens"] :] == 50256).all() and not places[r["n_tokens"] :].any()
    back = pieces_of(packing.unpacked(packed).collect(), 1, 2)
    total = {}
    for r in odd.collect():
        total.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).extend(ids_of(library, r["text"], 50256))
    assert {k: sorted(x for _, part in v for x in part) for k, v in back.items()} == {k: sorted(v) for k, v in total.items()}
    assert packing.pack_ids(none, PATH).count() == 0


def test_query_packs_the_ids_of_every_document(spark, sf, docs, library):
    back = pieces_of(packing.unpacked(registry.op4_packed_ids(spark, sf)).collect(), 1, 2)
    want = {r["doc_id"]: ids_of(library, r["text"], 50256) for r in docs.collect()}
    assert {k: [x for _, part in sorted(v) for x in part] for k, v in back.items()} == want


def test_best_fit_is_near_the_least_number_of_windows():
    rng = random.Random(5)
    lengths = [rng.choice([0, 1, 2048, 5000, rng.randint(1, 2500)]) for _ in range(3000)]
    windows = packing.best_fit(lengths, 2048)
    assert sum(n for w in windows for _, _, n in w) == sum(lengths)
    assert all(sum(n for *_, n in w) <= 2048 for w in windows)
    assert len(windows) <= -(-sum(lengths) // 2048) * 1.02


def test_rooms_find_the_nearest_size():
    rng, rooms, held = random.Random(6), packing.Rooms(100), []
    for _ in range(2000):
        n = rng.randint(0, 100)
        low = [h for h in held if h >= n]
        high = [h for h in held if h <= n]
        assert rooms.at_least(n) == (min(low) if low else None) and rooms.at_most(n) == (max(high) if high else None)
        if held and rng.random() < 0.5:
            held.remove(x := rng.choice(held))
            rooms.take(x)
        else:
            held.append(n)
            rooms.put(n, None)


def check_pieces(rows, wanted):
    """rows: pieces with unique keys; wanted: ids by key."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(wanted)
    for key, pieces in by_doc.items():
        at, ids = 0, np.array(wanted[key], "<u4")
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["window"] and at & (at - 1) == 0 and at <= 2048


def test_query_packs_every_document(spark, sf, docs, library):
    rows = registry.op5_tiered_packing(spark, sf).collect()
    check_pieces(rows, {r["doc_id"]: ids_of(library, r["text"], 1) for r in docs.collect()})


def test_tiers_of_odd_rows(spark, odd, none, library):
    rows = [r for r in odd.collect()]
    apart = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = tiers.pack_documents(apart, PATH, group=3000, with_ids=True).collect()
    check_pieces(got, {i: ids_of(library, r["text"], 1) for i, r in enumerate(rows)})
    assert tiers.pack_documents(odd, PATH).agg({"length": "sum"}).first()[0] == sum(len(ids_of(library, r["text"], 1)) for r in rows)
    assert tiers.pack_documents(none, PATH).count() == 0
    with pytest.raises(ValueError):
        tiers.pack_documents(odd, PATH, tiers=(2048, 1000))


def test_steps_are_even():
    rng = random.Random(8)
    windows = [rng.choice(tiers.TIERS) for _ in range(500)]
    step = tiers.step_groups(windows, 1 << 13)
    loads = np.bincount(step, weights=windows)
    assert loads.max() - loads.min() <= 2048 and len(loads) == -(-sum(windows) // (1 << 13))
