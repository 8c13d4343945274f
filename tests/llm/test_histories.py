"""Archives, capture histories, prefix tries and manifests against brute force, and on odd input."""

import base64
import hashlib
import random
import zlib

import duckdb
import pytest

from tidegate.llm import captures, merkle, oracles, prefixes, warc
from tidegate.llm.keyed import matched

PAGE = "page_id long, url string, html string, captured_us long, payload string, n int"
CONV = "conv_id long, turn long, role string, text string, id long, chars string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Archives and histories


def page_rows():
    rng = random.Random(5)
    rows = [(i, f"http://a{rng.randrange(4)}.example.com/{rng.randrange(3)}", f"page {rng.randrange(60)}", rng.randrange(20), "x", 1) for i in range(300)]
    rows += [(300, None, "p", 5, None, None), (301, "http://h/ \r\nX: y", None, 5, None, None), (302, "HTTPS://U@H.org:443?q#f", "", 5, None, None)]
    rows += [(303, "http://h/", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 3 + "é" * 200_000, 5, None, None), (7, "http://h/", "page 3", 2, None, None)]
    return rows + [rows[5], (None, "http://h/", "page 3", None, None, None), (None, None, "nowhere else", None, None, None)]


def test_captures_equal_brute_force(spark):
    rows = page_rows()
    found = captures.captured(spark.createDataFrame(rows, PAGE).repartition(5), records_per_file=40, per_range=25).collect()
    assert len({r["run"] for r in found}) > 5 and len({r["range_no"] for r in found}) > 5
    firsts = {}
    for page_id, _, html, *_ in rows:
        key = (html or "").encode()
        if page_id is not None:
            firsts[key] = min(firsts.get(key, page_id), page_id)
    want = []
    for page_id, url, html, at, *_ in rows:
        body = (html or "").encode()
        first = firsts.get(body)
        revisit = first is not None and page_id != first
        safe = (url or "").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page_id, warc.url_key(safe), at or 0, len(body), digest, "revisit" if revisit else "response", first if revisit else None))
    have = [(r["page_id"], r["url_key"], r["captured_us"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    ordered = sorted(found, key=lambda r: (r["range_no"], r["place"]))
    keys = [(r["url_key"], r["captured_us"], r["page_id"] is None, r["page_id"] or 0) for r in ordered]
    assert keys == sorted(keys)
    seen: dict = {}
    for r in ordered:
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["capture_no"] == seen[r["url_key"]]


def test_payloads_below_a_size_are_responses(spark):
    rows = [(1, "u", "ab", 0, None, None), (2, "u", "ab", 0, None, None), (3, "u", "abc", 0, None, None), (4, "u", "abc", 0, None, None)]
    found = captures.captured(spark.createDataFrame(rows, PAGE), least_bytes=3)
    assert rows_of(found, "page_id", "refers_to") == [(1, None), (2, None), (3, None), (4, 3)]


def test_no_pages(spark):
    assert captures.captured(spark.createDataFrame([], PAGE)).count() == 0


def test_records_come_back_from_their_offsets(spark, tmp_path):
    frame = warc.write_archives(warc.deduplicated(spark.createDataFrame(page_rows(), PAGE).coalesce(1)))
    path = frame.first()["file"]
    system, name = warc._opened(path)
    with system.open_input_file(name) as source:
        for row in warc.captures(path)[::17]:
            source.seek(row[9])
            headers, http, payload = warc.parse(zlib.decompress(source.read(row[10]), 31))
            assert headers["WARC-Record-ID"] == warc._name(row[3]) and int(http["Content-Length"]) == row[5]
            assert headers["WARC-Type"] == "revisit" or len(payload) == row[5]


def test_cut_or_changed_archives_are_refused(tmp_path):
    packed = [zlib.compress(warc.record(i, "u", 0, b"body", "NONE", None, False), 1, 31) for i in range(2)]
    changed = tmp_path / "a.warc.gz"
    changed.write_bytes(b"".join(packed))
    with pytest.raises(ValueError, match="digest"):
        warc.captures(str(changed))
    changed.write_bytes(b"".join(packed)[:-4])
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(str(changed)))


@pytest.mark.parametrize("number", [0, 1, 2, 3, 7, 16, 33])
def test_loser_trees_merge_in_order(number):
    rng = random.Random(number)
    runs = [sorted(rng.randrange(50) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(number)]
    merged = [(runs[r][at], r, at) for r, at in captures.LoserTree(runs)]
    assert merged == sorted((v, r, at) for r, run in enumerate(runs) for at, v in enumerate(run))


def test_hot_keys_are_matched_as_others(spark):
    rows = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)] + [(None, -1)], "k long, v long")
    table = rows.where("k is not null and k % 2 = 0").groupBy("k").agg({"v": "count"}).withColumnRenamed("count(v)", "n")
    for how in ("inner", "left"):
        assert rows_of(matched(rows, table, ["k"], "n", how, least=100), "k", "v", "n") == rows_of(rows.join(table, "k", how), "k", "v", "n")


# Prefix tries


def conversation_rows():
    rng = random.Random(9)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "y", "zé"]), 1, "c") for c in range(0, 320, 3) for t in range(rng.randrange(1, 7))]
    rows += [(c, 0, "u", "hello", 1, "c") for c in range(1000, 1200)]
    rows += [(500, t, "u", f"long {t}", 1, "c") for t in range(300)]
    rows += [(501, None, None, None, None, None), (501, None, "u", None, None, None), (501, 2, "u", "b", None, None), (501, 2, "u", "a", None, None)]
    rows += [(-250, 0, "u", "neg", None, None), (-200, 0, "u", "base", None, None), (None, 0, "u", "none", None, None), rows[0], rows[0], (None,) * 6]
    return rows


def brute_trie(rows):
    turns: dict = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((t is not None, t or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = own.get(base, [])[:h] + mine[h:]
    nodes: dict = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids: dict = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    below: dict = {}
    for p in sorted(nodes, key=len, reverse=True):
        mine = kids.get(p, [])
        saved = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(below[k][1] for k in mine)
        below[p] = (sum(below[k][0] for k in mine) or 1, saved)
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(built[c]) == len(p))))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(nodes[p]), len(p), up, len(nodes[p]), len(mine), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("per_shard,group", [(40, 2), (100, 3), (10**6, 64)])
def test_tries_equal_brute_force(spark, per_shard, group):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, CONV).repartition(4)
    found = prefixes.prefix_nodes(prefixes.shared_openings(prefixes.turn_sequences(df)), per_shard, group)
    assert rows_of(found, *NODE) == brute_trie(rows)


def test_no_conversations(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "u", "t", 1, "c")], CONV)).count() == 0


def test_many_equal_conversations_are_one_sequence(spark):
    """Members of a sequence are hashed in pieces; one row per sequence reaches the shards."""
    df = spark.range(20_000).selectExpr("id AS conv_id", "cast(null AS long) AS turn", "'u' AS role", "'hi' AS text")
    sequences = prefixes.turn_sequences(df)
    row = prefixes.distinct_sequences(sequences).collect()
    assert len(row) == 1 and row[0]["n"] == 20_000
    assert row[0]["ends"] == hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()


def test_medians_visit_each_place_once():
    for n in (0, 1, 2, 9, 100):
        assert sorted(prefixes.medians(n)) == list(range(n))
    tree = prefixes.TernaryTree()
    for place in prefixes.medians(1023):
        tree.insert([place], [1], 1, place, "e")

    def height(at):
        return 0 if not at else 1 + max(height(tree.lower[at]), height(tree.higher[at]))

    assert height(tree.equal[0]) == 10


# Manifests


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, arity=2):
    def leaf(r, add=0):
        cells = [r[0], r[3], r[2], None if r[4] is None else r[4] + add, r[1]]
        return h("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))

    def tree(nodes):
        """Root and, for each node, the path of (place, others)."""
        paths, owner = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, at in enumerate(owner):
                first = at - at % arity
                run = nodes[first : first + arity]
                paths[i].append((at - first, run[: at - first] + run[at - first + 1 :]))
                owner[i] = at // arity
            nodes = [h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        return nodes[0] if nodes else None, paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    mine = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    trees = {lang: tree([leaf(r) for r in mine[lang]]) for lang in langs}
    root, tops = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, over in zip(langs, tops, strict=True):
        for r, path in zip(mine[lang], trees[lang][1], strict=True):
            full = path + over
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = merkle.fold(leaf(r, int(tampered)), full)
            out.append((r[0], leaf(r), trees[lang][0], root, h("".join(x for _, o in full for x in o)), folded, folded == root))
    return sorted(out, key=repr)


RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def document_rows():
    rng = random.Random(3)
    rows = [(rng.randrange(-500, 100_000), f"text {i} é", rng.choice(["en", "de", "", None]), f"s{i % 3}", rng.randrange(9)) for i in range(400)]
    rows += [(i, f"t{i}", "dense", "s", i) for i in range(150)] + [(None, None, None, None, None), (None, "x", "en", None, 2**63 - 1), (2**63 - 1, "", "one", None, 2**63 - 1), (-(2**63), "", "en", None, 0)]
    return rows + [(77, f"version {i % 20}", "en", "s", 3) for i in range(60)] + [rows[0]] * 5


@pytest.mark.parametrize("levels,arity", [(1, 2), (3, 2), (2, 3), (12, 2)])
def test_manifests_equal_brute_force(spark, levels, arity):
    rows = document_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS place", "'x' AS tree").repartition(4)
    assert rows_of(merkle.manifest(df, levels, arity), *RESULT) == brute_manifest(rows, arity)


def test_a_hot_id_is_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_HOT_WORD", 30)
    rows = document_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert rows_of(merkle.manifest(df, 4), *RESULT) == brute_manifest(rows)


def test_single_and_no_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = merkle.manifest(spark.createDataFrame([(7, "t", "en", "s", 1)], schema)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h("")
    empty = merkle.manifest(spark.createDataFrame([], schema))
    assert empty.columns == RESULT and empty.count() == 0


def test_odd_rows(odd):
    found = merkle.manifest(odd)
    assert found.count() == odd.count() and found.select("root").distinct().count() == 1


# The SQL of the registered queries on the same odd rows


def in_duck(sql, **tables):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        columns = [c.split() for c in schema.split(", ")]
        names = ", ".join(f"{n} {'VARCHAR' if t == 'string' else 'BIGINT'}" for n, t in columns)
        con.execute(f"CREATE TABLE {name} ({names})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", [list(r) for r in rows])
    return con.execute(sql).fetchall()


def test_sql_of_tries_and_manifests_holds_for_odd_rows():
    rows = [r[:4] for r in conversation_rows()]
    have = in_duck(oracles.PREFIXES, conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(have, key=repr) == brute_trie(rows)
    rows = [r for r in document_rows() if r[4] != 2**63 - 1]
    have = in_duck(oracles.MANIFEST, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(have, key=repr) == brute_manifest(rows)
