"""Queries over table contents: sources, sinks, hashes, invariants, comparisons, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import DAY_US, query, rounded
from tidegate.catalog.pit import events, feature_sql
from tidegate.fixtures import load, source
from tidegate.functions.times import DAY, lit
from tidegate.operators import compare, quality, spatial
from tidegate.operators.features import FEATURES, point_in_time
from tidegate.plans.ordered import row_numbers
from tidegate.session import scratch, spread
from tidegate.sources import readers, sinks


_CUT = 1705795200000000  # 2024-01-21 00:00 UTC


@query(
    "src1_scan_transactions",
    "SELECT event_id, epoch_us(ts) AS event_us, user_id, value, props FROM events",
)
def src1(spark, folder):
    """SRC-1: the raw table with a declared schema."""
    rows = readers.with_micros(readers.scan_events(spark, folder), event_us="ts")
    return rows.select("event_id", "event_us", "user_id", "value", "props")


@query("src2_scan_derived", f"SELECT seq, {', '.join(FEATURES)} FROM f", ("history",), {"f": feature_sql()})
def src2(spark, folder):
    """SRC-2, SINK-1: features written once with a manifest, read back after all checks."""
    history = events(spark, folder)
    digest = quality.content_hash(history).first()["digest"]
    path = scratch(spark, "derived")
    sinks.write_once(point_in_time(history).select("seq", *FEATURES), path, source_digest=digest)
    return readers.scan_derived(spark, path, digest)


@query("src3_to_events", "SELECT event_id, customer_id, terminal_id, amount_minor, event_us, received_us, payload_hash, source_id FROM history", ("history",))
def src3(spark, folder):
    """SRC-3: raw rows as events with their payload hash, built by the library's own expressions."""
    rows = load(spark, folder, "history").drop("payload_hash", "source_id").withColumnRenamed("event_id", "transaction_id")
    return readers.to_events(rows.withColumn("currency", F.lit("usd")))


@query("src5_csv_source", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def src5(spark, folder):
    """SRC-5: a CSV file with a header, read as text and cast."""
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    path = scratch(spark, "csv")
    source(spark, folder, "orders").select(*columns).write.option("header", True).csv(path)
    return readers.csv_source(spark, path, columns, o_orderkey="bigint", o_custkey="bigint", o_totalprice="double")


@query(
    "src6_relational_scan",
    """SELECT d.transaction_id, d.action, o.stream, r.id AS review_id FROM decisions d
       JOIN outbox o ON o.aggregate_id = d.transaction_id JOIN reviews r ON r.transaction_id = d.transaction_id""",
    ("decisions", "outbox", "reviews"),
)
def src6(spark, folder):
    """SRC-6: decisions, events and reviews as tables."""
    d, o, r = (load(spark, folder, n) for n in ("decisions", "outbox", "reviews"))
    joined = d.join(o, F.col("transaction_id") == F.col("aggregate_id")).select("transaction_id", "action", "stream")
    return joined.join(r.select("transaction_id", F.col("id").alias("review_id")), "transaction_id")


@query("sink1_write_once", "SELECT count(*) AS rows, count(*) AS manifest_rows, TRUE AS refused FROM txn", ("txn",))
def sink1(spark, folder):
    """SINK-1: a second write to the same place is refused."""
    rows, path = load(spark, folder, "txn"), scratch(spark, "once")
    first = sinks.write_once(rows, path)
    try:
        sinks.write_once(rows, path)
        refused = False
    except sinks.AlreadyWritten:
        refused = True
    return spark.read.parquet(f"{path}/data").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(first["rows"]).cast("bigint").alias("manifest_rows"), F.lit(refused).alias("refused")
    )


@query(
    "sink2_idempotent_insert",
    """SELECT d.seq, CASE WHEN s.payload_hash = d.payload_hash THEN 'replay' WHEN s.payload_hash IS NOT NULL THEN 'conflict'
                          WHEN d.seq = f.seq THEN 'new' WHEN d.payload_hash = f.payload_hash THEN 'replay' ELSE 'conflict' END AS verdict
       FROM deliveries d JOIN (SELECT event_id, arg_min(seq, (received_us, seq)) AS seq, arg_min(payload_hash, (received_us, seq)) AS payload_hash
                               FROM deliveries GROUP BY event_id) f ON f.event_id = d.event_id
       LEFT JOIN (SELECT event_id, payload_hash FROM history WHERE received_us < 1705795200000000) s ON s.event_id = d.event_id""",
    ("deliveries",),
)
def sink2(spark, folder):
    """SINK-2: which rows of a batch may be inserted, given those stored before an instant."""
    stored = load(spark, folder, "history").filter(F.col("received_us") < _CUT)
    rows = load(spark, folder, "deliveries")
    return sinks.classify_inserts(rows, stored, "event_id", "payload_hash", ["received_us", "seq"]).select("seq", "verdict")


def _digest_sql(table: str, columns: list[str], texts: dict[str, str] | None = None) -> str:
    def field(c: str) -> str:
        value = (texts or {}).get(c, f"CAST({c} AS VARCHAR)")
        return f"'{len(c)}:{c}=' || coalesce(CAST(length({value}) AS VARCHAR) || ':' || {value}, '-')"

    text = " || ".join(field(c) for c in sorted(columns))
    slices = ", '-', ".join(
        f"CAST(coalesce(sum(CAST(concat('0x', substr(h, {1 + 15 * i}, 15)) AS BIGINT)), 0) AS VARCHAR)" for i in range(4)
    )
    return f"SELECT count(*) AS rows, concat({slices}) AS digest FROM (SELECT sha256({text}) AS h FROM {table}) t"


_TXN_COLUMNS = ["txn_id", "customer_key", "terminal_key", "amount_minor", "event_us", "received_us", "is_fraud"]


@query("dq1_content_hash", _digest_sql("txn", _TXN_COLUMNS), ("txn",))
def dq1(spark, folder):
    """DQ-1: a digest of the rows that does not depend on their order."""
    return quality.content_hash(load(spark, folder, "txn").select(*_TXN_COLUMNS))


@query(
    "sink3_manifest",
    f"""SELECT d.*, round((SELECT avg(CAST(is_fraud AS INT)) FROM txn), 9) AS fraud, round((SELECT avg(CAST(fraud_s1 AS INT)) FROM txn), 9) AS s1
        FROM ({_digest_sql('txn', [*_TXN_COLUMNS, 'fraud_s1'])}) d""",
    ("txn",),
)
def sink3(spark, folder):
    """SINK-3: what a manifest records of a table."""
    rows = load(spark, folder, "txn").select(*_TXN_COLUMNS, "fraud_s1")
    return rounded(sinks.manifest_columns(rows, {"fraud": F.col("is_fraud"), "s1": F.col("fraud_s1")}), "fraud", "s1")


@query(
    "dq2_verify_dataset",
    """SELECT 'bad' AS dataset, 'content hash mismatch' AS problem WHERE EXISTS (SELECT 1 FROM txn WHERE txn_id % 100 = 0)""",
    ("txn",),
)
def dq2(spark, folder):
    """DQ-2: a written table against its manifest, and against a damaged one."""
    rows, path, other = load(spark, folder, "txn"), scratch(spark, "good"), scratch(spark, "bad")
    sinks.write_once(rows, path)
    sinks.write_once(rows, other)
    damaged = rows.withColumn("amount_minor", F.col("amount_minor") + (F.col("txn_id") % 100 == 0).cast("bigint"))
    damaged.write.mode("overwrite").parquet(f"{other}/data")
    found = [("good", p) for p in readers.verify(spark, path)] + [("bad", p) for p in readers.verify(spark, other)]
    return spark.createDataFrame(found, "dataset string, problem string")


@query(
    "dq3_invariants",
    """SELECT count(*) FILTER (WHERE received_us < event_us) AS received_before_event, count(*) FILTER (WHERE label_us <= event_us) AS label_not_after_event,
              count(*) FILTER (WHERE amount_minor <= 0) AS amount_not_positive,
              count(*) FILTER (WHERE is_fraud <> (fraud_s1 OR fraud_s2 OR fraud_s3)) AS flag_not_union,
              count(*) - count(DISTINCT txn_id) AS repeated_ids FROM txn""",
    ("txn",),
)
def dq3(spark, folder):
    """DQ-3: rows that break a rule of the table."""
    return quality.invariants(load(spark, folder, "txn"))


@query(
    "dq4_compare_copies",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS text_differences,
                   count(*) FILTER (WHERE TRY_CAST(a.{c} AS DOUBLE) IS DISTINCT FROM TRY_CAST(b.{c} AS DOUBLE)) AS number_differences
            FROM copy_a a JOIN copy_b b ON a.k = b.k"""
        for c in ("price", "status", "cust")
    ),
    ("copy_a", "copy_b"),
)
def dq4(spark, folder):
    """DQ-4: cells that differ between two copies, as text and as numbers."""
    return quality.cell_differences(load(spark, folder, "copy_a"), load(spark, folder, "copy_b"), "k", ["price", "status", "cust"])


@query(
    "dq4_difference_examples",
    """SELECT a.k, a.price AS "left", b.price AS "right" FROM copy_a a JOIN copy_b b ON a.k = b.k WHERE a.price <> b.price ORDER BY a.k LIMIT 5""",
    ("copy_a", "copy_b"),
)
def dq4_examples(spark, folder):
    """DQ-4: the first differing cells."""
    return quality.difference_examples(load(spark, folder, "copy_a"), load(spark, folder, "copy_b"), "k", "price", 5)


@query(
    "join11_by_row_number",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE a.price <> b.price) AS price_differs, count(*) FILTER (WHERE a.status <> b.status) AS status_differs
       FROM (SELECT *, row_number() OVER (ORDER BY k) AS r FROM copy_a) a JOIN (SELECT *, row_number() OVER (ORDER BY k) AS r FROM copy_b) b ON a.r = b.r""",
    ("copy_a", "copy_b"),
)
def join11(spark, folder):
    """JOIN-11: two copies aligned by row number."""
    a = row_numbers(load(spark, folder, "copy_a"), [F.col("k")], name="r")
    b = row_numbers(load(spark, folder, "copy_b"), [F.col("k")], name="r")
    return compare.aligned(a, b, "r", ["price", "status"]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(compare.different("price")).alias("price_differs"),
        F.count_if(compare.different("status")).alias("status_differs"),
    )


@query(
    "set2_multiset_equality",
    """SELECT (SELECT count(*) FROM (SELECT * FROM copy_a EXCEPT ALL SELECT * FROM copy_b)) AS only_left,
              (SELECT count(*) FROM (SELECT * FROM copy_b EXCEPT ALL SELECT * FROM copy_a)) AS only_right""",
    ("copy_a", "copy_b"),
)
def set2(spark, folder):
    """SET-2: rows that only one of two tables has, counting repetitions."""
    return compare.same_rows(load(spark, folder, "copy_a"), load(spark, folder, "copy_b"))




@query(
    "set1_partition_property",
    f"""SELECT count(*) FILTER (WHERE received_us < {_CUT}) + count(*) FILTER (WHERE received_us >= {_CUT}) AS parts, count(*) AS whole,
               CAST(0 AS BIGINT) AS overlap, CAST(0 AS BIGINT) AS missing FROM txn""",
    ("txn",),
)
def set1(spark, folder):
    """SET-1: bootstrap and scoring rows are disjoint and together are all rows."""
    rows = load(spark, folder, "txn")
    ids = rows.select("txn_id")
    before, after = ids.filter(rows["received_us"] < _CUT), ids.filter(rows["received_us"] >= _CUT)
    parts = before.unionByName(after)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (
        one(parts, "parts")
        .withColumn("whole", one(ids, "n").scalar())
        .withColumn("overlap", one(before.intersect(after), "n").scalar())
        .withColumn("missing", one(ids.exceptAll(parts), "n").scalar())
    )


@query("set3_stream_assembly", "SELECT seq, event_id, source_id, amount_minor, received_us FROM deliveries", ("deliveries",))
def set3(spark, folder):
    """SET-3: a delivery stream assembled from events, repetitions and conflicts."""
    h = load(spark, folder, "history").select("seq", "event_id", "source_id", "amount_minor", "received_us")

    def part(every: int, number: int, delay_s: int):
        rows = h.filter(F.col("seq") % every == 0) if every > 1 else h
        return rows.withColumns({"seq": F.col("seq") * 8 + number, "received_us": F.col("received_us") + lit(delay_s * 1_000_000)})

    parts = [
        part(1, 0, 0),
        part(37, 1, 60),
        part(101, 2, 120).withColumn("amount_minor", F.col("amount_minor") + 1),
        part(211, 3, 180).withColumn("source_id", F.concat(F.lit("S-"), "event_id")),
        part(307, 4, 240).withColumn("event_id", F.concat(F.lit("X-"), "event_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "dq5_scenario_labels",
    """SELECT t.txn_id, t.amount_minor > 15000 AS fraud_s1,
              EXISTS (SELECT 1 FROM calendar c WHERE c.terminal_key = t.terminal_key AND t.event_us // 86400000000 >= c.day AND t.event_us // 86400000000 < c.day + 3) AS fraud_s2,
              t.customer_key % 40 = 3 AS fraud_s3,
              t.amount_minor > 15000 OR t.customer_key % 40 = 3
                OR EXISTS (SELECT 1 FROM calendar c WHERE c.terminal_key = t.terminal_key AND t.event_us // 86400000000 >= c.day AND t.event_us // 86400000000 < c.day + 3) AS is_fraud
       FROM txn t""",
    ("txn", "calendar"),
)
def dq5(spark, folder):
    """DQ-5, JOIN-8: labels by amount, by a calendar of terminals, and by customer."""
    rows = load(spark, folder, "txn").select("txn_id", "amount_minor", "terminal_key", "customer_key", (F.floor(F.col("event_us") / DAY)).cast("bigint").alias("day"))
    flagged = spatial.in_calendar(rows, load(spark, folder, "calendar"), "terminal_key", "day", 3, "listed")
    flagged = flagged.withColumn("leaked", F.col("customer_key") % 40 == 3)
    return quality.scenario_labels(flagged, 15000, "listed", "leaked").select("txn_id", "fraud_s1", "fraud_s2", "fraud_s3", "is_fraud")


@query(
    "join8_calendar_windows",
    """SELECT terminal_key, count(*) AS rows, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM calendar c WHERE c.terminal_key = t.terminal_key
         AND t.event_us // 86400000000 >= c.day AND t.event_us // 86400000000 < c.day + 7)) AS listed FROM txn t GROUP BY terminal_key""",
    ("txn", "calendar"),
)
def join8(spark, folder):
    """JOIN-8: events inside the windows that a calendar lists for their terminal."""
    rows = load(spark, folder, "txn").select("terminal_key", (F.floor(F.col("event_us") / DAY)).cast("bigint").alias("day"))
    flagged = spatial.in_calendar(rows, load(spark, folder, "calendar"), "terminal_key", "day", 7, "hit")
    return flagged.groupBy("terminal_key").agg(F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("listed"))


@query(
    "dq6_label_availability",
    f"SELECT txn_id, event_us + CASE WHEN is_fraud THEN (1 + (txn_id * 104729) % 29) * {DAY_US} ELSE 30 * {DAY_US} END AS label_us FROM txn",
    ("txn",),
)
def dq6(spark, folder):
    """DQ-6: when each outcome becomes known; the delay comes from a hash of the key."""
    delay = (lit(1) + F.pmod(F.col("txn_id") * 104729, lit(29))) * lit(DAY)
    known = quality.label_available(F.col("event_us"), F.col("is_fraud"), delay)
    return load(spark, folder, "txn").select("txn_id", known.alias("label_us"))


@query(
    "join9_radius_counts",
    """SELECT h.id, count(s.id) AS near FROM homes h LEFT JOIN shops s ON sqrt((h.x - s.x) * (h.x - s.x) + (h.y - s.y) * (h.y - s.y)) <= 12.5 GROUP BY h.id""",
    ("homes", "shops"),
)
def join9(spark, folder):
    """JOIN-9: shops within a radius of each home."""
    return spatial.near_counts(load(spark, folder, "homes"), load(spark, folder, "shops"), "id", 12.5)


# The rules of DQ-7 in the dialect of another engine, written apart from those of the operator.
_LINE_RULES = {
    "home_path": r"regexp_matches(line, '(?:^|[^A-Za-z0-9])/(?:home|Users)/\w|[A-Za-z]:\\Users\\\w')",
    "github_noreply": r"regexp_matches(line, '(?:^|[^0-9])\d+\+[A-Za-z0-9-]+@users\.noreply\.github\.com[.-]*(?:$|[^A-Za-z0-9.-])')",
    "email": r"""len(list_filter(regexp_extract_all(line, '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}'), lambda m:
                 NOT ends_with(m, '@users.noreply.github.com') AND NOT regexp_matches(m, '[@.]example\.(com|net|org)$'))) > 0""",
    "private_key": "regexp_matches(line, '-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----')",
    "token": r"""regexp_matches(line, '(?:^|[^\w-])(?:AKIA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{30})')
                 OR regexp_matches(line, '(?:^|[^\w-])(?:sk-[A-Za-z0-9]{20}|xox[abprs]-[A-Za-z0-9-]{10}|eyJ[\w-]{20,}\.[\w-]{10})')""",
    "private_ip": r"""regexp_matches(line, '(?:^|[^0-9.])(?:10\.\d{1,3}|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.\d{1,3}\.\d{1,3}(?:$|[^0-9.])')""",
    "host_name": r"regexp_matches(line, '[A-Za-z0-9-]\.(?:local|lan|internal)(?:$|[^A-Za-z0-9.-])') OR regexp_matches(line, '[A-Za-z]s-(?:MacBook|iMac|Mac-mini)')",
    "credential": r"""len(list_filter(regexp_extract_all(lower(line), '\b(\w+) ?[=:] ?["'']?[^\s"'']{6}', 1), lambda n:
                      regexp_matches(n, 'password|passwd|secret|api_?key|token'))) > 0""",
    "personal_term": "contains(lower(line), 'the')",
}


def _text_sql() -> str:
    parts = [f"SELECT doc_id, '{name}' AS category, count(*) AS lines FROM l WHERE {rule} GROUP BY doc_id" for name, rule in _LINE_RULES.items()]
    return " UNION ALL ".join(parts)


@query("dq7_sensitive_files", "SELECT page_id, 'sensitive_file' AS category FROM pages WHERE page_id % 7 < 4")
def dq7_files(spark, folder):
    """DQ-7: paths that name files of secrets, state or logs; the pages' URLs with file names of seven kinds."""
    names = F.split(F.lit(".env state.db server.key worker.log notes.txt environment a.key.txt"), " ")
    named = F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("/"), F.element_at(names, (F.pmod("page_id", F.lit(7)) + 1).cast("int")))
    return quality.sensitive_files(source(spark, folder, "pages").withColumn("path", named), "page_id", "path")


@query(
    "dq7_sensitive_text",
    _text_sql(),
    (),
    {"l": r"SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM documents"},
)
def dq7(spark, folder):
    """DQ-7: lines of each document with sensitive text, by category."""
    return quality.sensitive_lines(spread(source(spark, folder, "documents")), "doc_id", "text", terms=["the"])


@query(
    "dq7_sensitive_conversations",
    _text_sql().replace("doc_id", "conv_id"),
    (),
    {"l": r"SELECT conv_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM conversations"},
)
def dq7_conversations(spark, folder):
    """DQ-7: the same over conversations, summed over their turns."""
    found = quality.sensitive_lines(spread(source(spark, folder, "conversations")), "conv_id", "text", terms=["the"])
    return found.groupBy("conv_id", "category").agg(F.sum("lines").alias("lines"))
