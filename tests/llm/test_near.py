"""SimHash groups, near copies, embeddings and components against brute force."""

import math
import random

import numpy as np
import pytest
import xxhash

from tidegate.llm import embeddings, nearcopies, registry, simhash
from tidegate.plans.components import components


def reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (None, 3), (9, 9)]
    edges += [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(90)] + [(101, 100), (100, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    held = [(a, b) for a, b in edges if a is not None]
    assert got == reachable({x for e in held for x in e}, held)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_tables_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    kept = simhash.masks(radius)
    assert len(kept) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius)))
        assert any(difference & m == 0 for m in kept)


def printed(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_equals_brute_force(spark, sf, docs):
    rows = docs.collect()
    prints = {r["doc_id"]: printed(r["text"]) for r in rows}
    ids = list(prints)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = reachable(ids, edges)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op7_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


@pytest.mark.parametrize("small,radius", [(32, 2), (1, 2), (2, 3), (1, 1)])
def test_large_buckets_lose_no_link(spark, small, radius):
    rng = random.Random(9)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(12):
            values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    values = [simhash.signed(v) for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, small).collect()
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(0 < distance(r["a"], r["b"]) <= radius for r in found)
    pairs = [(a, b) for i, a in enumerate(values) for b in values[:i] if distance(a, b) <= radius]
    assert reachable(values, [(r["a"], r["b"]) for r in found]) == reachable(values, pairs)


def test_simhash_of_odd_rows(odd, none):
    rows = odd.collect()
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(rows)
    blank = {r["doc_id"] for r in rows if not (r["text"] or "").split()}
    for r in got:
        if r["doc_id"] in blank and r["doc_id"] is not None:
            assert (r["fingerprint"], r["component"]) == ("0" * 16, 0)
    pair = {r["component"] for r in got if r["doc_id"] == 6}
    assert pair == {5}
    assert simhash.simhash_groups(none).count() == 0


def shingled(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([b" ".join(words)])


def kept_of(rows):
    """Keys of the documents that stay, by comparing all pairs."""
    sets = [shingled(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = reachable(range(len(rows)), edges)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(roots[i], []).append(key)
    return sorted(min(g, key=lambda k: (k is not None, k)) if any(k is None for k in g) else min(g) for g in groups.values())


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, passage = [], " ".join(word() for _ in range(30))
    for _ in range(25):
        words = [word() for _ in range(rng.choice([3, 8, 40, 150, 600]))]
        for _ in range(rng.randint(1, 6)):
            copy = [word() if rng.random() < rng.choice([0, 0, 0.01, 0.03, 0.2]) else w for w in words]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    rows += [(len(rows) + i, f"{passage} {' '.join(word() for _ in range(60))}") for i in range(20)]  # a shared passage is no copy
    want = kept_of(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(r["doc_id"] for r in nearcopies.one_of_each(docs).collect())
    assert got == want and len(want) < len(rows)


@pytest.mark.parametrize("size,other", [(4, 5), (8, 10), (9, 9), (18, 18), (16, 20)])
def test_short_near_copies_are_found(spark, size, other):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(60):
        words = [word() for _ in range(size + 4)]
        copy = words + [word() for _ in range(other - size)] if other > size else [*words[:-1], word()]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    want = kept_of(rows)
    got = sorted(r["doc_id"] for r in nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == want == list(range(0, 120, 2))


def versions(rng, families, times, length, changed):
    """Edited versions of some texts, mostly unlike each other, every fourth with a near copy of its own."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(families):
        words = [word() for _ in range(length)]
        for i in range(times):
            copy = [word() if rng.random() < changed else w for w in words]
            rows.append(" ".join(copy))
            if i % 4 == 0:
                place = rng.randrange(length)
                rows.append(" ".join([*copy[:place], word(), *copy[place + 1 :]]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small,block", [(32, 256), (4, 16)])
def test_near_copies_among_versions_of_one_text(spark, monkeypatch, small, block):
    """Versions share buckets with first members that they aren't like."""
    monkeypatch.setattr(nearcopies, "SMALL", small)
    monkeypatch.setattr(nearcopies, "MEMBERS", block)
    rng = random.Random(8)
    rows = [(i, t) for i, (_, t) in enumerate(versions(rng, 2, 150, 60, 0.04) + versions(rng, 2, 150, 250, 0.035))]
    want = kept_of(rows)
    got = sorted(r["doc_id"] for r in nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == want


def test_near_copies_of_odd_rows(odd, none):
    rows = odd.collect()
    left = nearcopies.one_of_each(odd)
    assert left.columns == odd.columns
    got = left.collect()
    texts = [tuple((r["text"] or "").encode().lower().split()) for r in got]
    assert len(set(texts)) == len(texts) == len({tuple((r["text"] or "").encode().lower().split()) for r in rows})
    assert nearcopies.one_of_each(none).count() == 0


def vectors(seed, dims=32):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dims) for _ in range(120)]
    for center in rows[:6]:
        rows += [center + 0.25 * rng.standard_normal(dims) for _ in range(25)]
    rows += [rows[0]] * 30 + [3 * rows[1]]
    return [[float(np.float32(x)) for x in r] for r in rows]


@pytest.mark.parametrize("block", [256, 7])
def test_embedding_links_equal_brute_force(spark, block):
    rows = vectors(3)
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    hits = unit @ unit.T >= 0.9
    np.fill_diagonal(hits, False)
    table = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_groups(table, block=block).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    # No link but true ones, and nearly all of those at the very threshold.
    assert (links <= hits.sum(axis=1)).all() and links.sum() >= 0.95 * hits.sum()
    roots = reachable(range(len(rows)), zip(*np.nonzero(hits)))
    same = np.mean([got[i]["component"] == roots[i] for i in range(len(rows))])
    assert same >= 0.95 and all(got[i]["kept"] == (got[i]["component"] == i) for i in range(len(rows)))


def test_query_on_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    unit = np.array([r["embedding"] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = unit @ unit.T >= 0.9
    got = {r["vec_id"]: r["n_links"] for r in registry.op6_embeddings(spark, sf).collect()}
    assert got == {r["vec_id"]: int(h.sum()) - 1 for r, h in zip(rows, hits)}


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embeddings.near_groups(table).collect()), key=str)
    want = [(0, 3, 0, True), (1, 3, 0, False), *[(i, 0, i, True) for i in range(2, 9)], (9, 3, 0, False), (9, 3, 0, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert embeddings.near_groups(table.limit(0)).count() == 0


@pytest.mark.parametrize("kind,offset", [("float", 0.0), ("double", 2.0), ("float", 3.0)])
def test_embeddings_with_a_common_offset_are_found(spark, kind, offset):
    """Vectors whose mean has a norm of up to 0.95: at least 0.95 of the links by brute force are found, none else."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 32)) + offset
    x[1000:] = x[:500] + rng.uniform(0.2, 0.9, (500, 1)) * rng.standard_normal((500, 32))
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    threshold = 0.9 if offset == 0 else 0.97 if offset == 2.0 else 0.985
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= threshold).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_groups(df, threshold=threshold).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.95 * want.sum() > 100


def test_double_vectors_are_compared_in_double(spark):
    rows = [(1, [1e300, 1.0]), (2, [1e300, 1e299]), (3, [1.0, 0.0]), (4, [1.0, 1e-9])]
    got = embeddings.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=1 - 1e-12).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {1: 2, 2: 0, 3: 2, 4: 2}
