"""The library's tables derived from the generic tables of a test-data folder.

Each table is one SQL text that runs in Spark as well as in DuckDB; only the expressions that the
two spell differently are filled in. That keeps a query and its oracle on the same input.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from tidegate.session import prepare, spread

REVIEW_AT, DECLINE_AT = 0.6, 0.75

# How the two dialects spell the same expression.
SPARK = {
    "k": "CAST(get_json_object(props,'$.k') AS BIGINT)",
    "us": "unix_micros(CAST(ts AS TIMESTAMP))",
    "fmt": "format_string",
    "div": "div",
    "utc": "date_format(timestamp_micros({0}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
    "sha": "sha2({0}, 256)",
}
DUCK = {
    "k": "CAST(props->>'$.k' AS BIGINT)",
    "us": "epoch_us(ts)",
    "fmt": "printf",
    "div": "//",
    "utc": "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S.%fZ')",
    "sha": "sha256({0})",
}


def _utc(us: str, d: dict) -> str:
    return d["utc"].format(us)


def _canonical(d: dict, txn: str, cust: str, term: str, amount: str, us: str) -> str:
    return (
        f"concat('{{\"amount_minor\":', CAST({amount} AS {'STRING' if d is SPARK else 'VARCHAR'}), "
        f"',\"currency\":\"USD\",\"customer_id\":\"', {cust}, '\",\"event_time\":\"', {_utc(us, d)}, "
        f"'\",\"hash_version\":1,\"terminal_id\":\"', {term}, '\",\"transaction_id\":\"', {txn}, '\"}}')"
    )


def _tables(d: dict) -> dict[str, str]:
    fmt, text = d["fmt"], "STRING" if d is SPARK else "VARCHAR"
    hashed = d["sha"].format(_canonical(d, "event_id", "customer_id", "terminal_id", "amount_minor", "event_us"))
    if d is SPARK:
        repeated = """
                SELECT seq * 8 + n AS seq, concat(p, event_id) AS event_id, customer_id, terminal_id,
                       amount_minor + CASE WHEN n = 2 THEN 1 ELSE 0 END AS amount_minor, event_us,
                       received_us + n * CAST(60000000 AS BIGINT) AS received_us, concat(s, event_id) AS source_id
                FROM (SELECT *, inline(filter(array(
                          named_struct('n', 0L, 'p', '', 's', '', 'keep', true),
                          named_struct('n', 1L, 'p', '', 's', '', 'keep', seq % 37 = 0),
                          named_struct('n', 2L, 'p', '', 's', '', 'keep', seq % 101 = 0),
                          named_struct('n', 3L, 'p', '', 's', 'S-', 'keep', seq % 211 = 0),
                          named_struct('n', 4L, 'p', 'X-', 's', '', 'keep', seq % 307 = 0)), v -> v.keep))
                      FROM history) v"""
        reasons = (
            "array_compact(array(CASE WHEN txn_id % 29 = 0 THEN 'FEATURES_UNAVAILABLE' END, "
            "CASE WHEN txn_id % 13 = 0 THEN 'PIPELINE_DEGRADED' END, "
            "CASE WHEN txn_id % 13 = 0 THEN 'OUTBOX_BACKLOG_AGED' END, rule))"
        )
        reviewed = "(SELECT *, explode(sequence(0, CAST(txn_id % 3 AS INT) - 1)) AS k FROM decisions WHERE action = 'review' AND txn_id % 3 > 0) d"
    else:
        repeated = """
                SELECT seq * 8 AS seq, event_id, customer_id, terminal_id, amount_minor, event_us,
                       received_us, event_id AS source_id FROM history
                UNION ALL
                SELECT seq * 8 + 1, event_id, customer_id, terminal_id, amount_minor, event_us,
                       received_us + 60000000, event_id FROM history WHERE seq % 37 = 0
                UNION ALL
                SELECT seq * 8 + 2, event_id, customer_id, terminal_id, amount_minor + 1, event_us,
                       received_us + 120000000, event_id FROM history WHERE seq % 101 = 0
                UNION ALL
                SELECT seq * 8 + 3, event_id, customer_id, terminal_id, amount_minor, event_us,
                       received_us + 180000000, concat('S-', event_id) FROM history WHERE seq % 211 = 0
                UNION ALL
                SELECT seq * 8 + 4, concat('X-', event_id), customer_id, terminal_id, amount_minor,
                       event_us, received_us + 240000000, event_id FROM history WHERE seq % 307 = 0"""
        reasons = (
            "list_filter([CASE WHEN txn_id % 29 = 0 THEN 'FEATURES_UNAVAILABLE' END, "
            "CASE WHEN txn_id % 13 = 0 THEN 'PIPELINE_DEGRADED' END, "
            "CASE WHEN txn_id % 13 = 0 THEN 'OUTBOX_BACKLOG_AGED' END, rule], lambda x: x IS NOT NULL)"
        )
        reviewed = "(SELECT *, unnest(range(0, CAST(txn_id % 3 AS INT))) AS k FROM decisions WHERE action = 'review' AND txn_id % 3 > 0) d"
    dbl = "DOUBLE"
    if d is SPARK:
        le_rows = "explode(array('0.05', '0.1', '0.2', '0.4', '+Inf'))"
    else:
        le_rows = "unnest(['0.05', '0.1', '0.2', '0.4', '+Inf'])"
    models = [("rules", "amount", 9, 0, 0), ("rules", "ratio", 0, 9, 0), ("linear", "C=0.1", 5, 4, 500), ("linear", "C=1", 6, 3, 700), ("trees", "depth=3", 5, 3, 1100), ("trees", "depth=6", 4, 3, 1400)]
    if d is SPARK:
        listed = ", ".join(f"struct('{f}' AS family, '{c}' AS config, {a} AS wa, {b} AS wb, {e} AS wc)" for f, c, a, b, e in models)
        per_model = f"(SELECT *, inline(array({listed})) FROM scored)"
    else:
        listed = ", ".join(f"('{f}', '{c}', {a}, {b}, {e})" for f, c, a, b, e in models)
        per_model = f"(SELECT * FROM scored, (VALUES {listed}) m(family, config, wa, wb, wc))"
    return {
        # Pipeline health, one row per minute with traffic.
        "health": f"""
            SELECT CASE WHEN m % 5 = 0 THEN 'replay:r1' ELSE 'live' END AS namespace, at_us,
                   CASE WHEN m % 17 = 0 THEN NULL ELSE at_us - ((m * 7919) % 90) * 1000000 END AS heartbeat_us,
                   CASE WHEN m % 7 < 2 THEN NULL ELSE at_us - ((m * 104729) % 1300) * 1000000 END AS oldest_us,
                   CASE WHEN m % 23 < 3 THEN -1 ELSE (m * 31) % 1500 END AS reported_lag,
                   (m * 7907) % 60000 AS backlog_rows
            FROM (SELECT m, m * CAST(60000000 AS BIGINT) AS at_us
                  FROM (SELECT DISTINCT received_us {d['div']} 60000000 AS m FROM txn) a) b""",
        # Hourly scrapes of counters that start again in the middle of the month.
        "served": f"""
            SELECT received_us {d['div']} 3600000000 AS h, ((txn_id * 7919) % 500) AS ms,
                   CASE WHEN txn_id % 53 = 0 THEN '503' WHEN txn_id % 31 = 0 THEN '422' ELSE '201' END AS status
            FROM txn""",
        "counted": f"""
            SELECT h, concat('request_seconds_bucket{{stage="request_total",le="', le, '"}}') AS sample,
                   count(CASE WHEN le = '+Inf' OR ms <= CAST(CASE WHEN le = '+Inf' THEN '0' ELSE le END AS {dbl}) * 1000 THEN 1 END) AS n
            FROM (SELECT h, ms, {le_rows} AS le FROM served) b GROUP BY h, le
            UNION ALL
            SELECT h, concat('responses_total{{status="', status, '"}}') AS sample, count(*) AS n
            FROM served GROUP BY h, status""",
        "scrapes": """
            SELECT h * CAST(3600000000 AS BIGINT) AS scrape_us, sample,
                   CAST(sum(n) OVER (PARTITION BY sample, h < 473700 ORDER BY h) AS DOUBLE) AS value
            FROM counted""",
        # Messages of the decisions, some of them damaged in one of the known ways.
        "payloads": f"""
            SELECT d.txn_id, d.customer_id, d.terminal_id, d.transaction_id, d.amount_minor, d.event_us,
                   concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS event_id,
                   {d['sha'].format(_canonical(d, 'd.transaction_id', 'd.customer_id', 'd.terminal_id', 'd.amount_minor', 'd.event_us'))} AS payload_hash,
                   d.received_us, d.decision_us, d.persisted_us, d.action, d.score, d.model_version, d.policy_version
            FROM (SELECT *, {d['sha'].format('transaction_id')} AS h FROM decisions) d""",
        "messages": f"""
            SELECT txn_id, CASE WHEN txn_id % 89 = 4 THEN 'C999999' ELSE customer_id END AS key_text,
                   CASE WHEN txn_id % 89 = 1 THEN substr(value, 1, 40) ELSE value END AS value_text,
                   event_id, CASE WHEN txn_id % 89 = 5 THEN 'decision.unmade' ELSE 'decision.made' END AS header_type
            FROM (SELECT txn_id, customer_id, event_id,
                  concat('{{"action":"', action, '","amount_minor":', CASE WHEN txn_id % 89 = 2 THEN '"7"' ELSE CAST(amount_minor AS {text}) END,
                    ',"currency":"', CASE WHEN txn_id % 89 = 3 THEN 'EUR' ELSE 'USD' END, '","customer_id":"', customer_id,
                    '","decision_time":"', {_utc('decision_us', d)}, '","event_id":"', event_id,
                    '","event_time":"', {_utc('event_us', d)}, '","event_type":"decision.made","feature_version":"f1","model_version":"', model_version,
                    '","payload_hash":"', CASE WHEN txn_id % 89 = 6 THEN {d['sha'].format("'x'")} ELSE payload_hash END,
                    '","persisted_at":"', {_utc('persisted_us', d)}, '","policy_version":"', policy_version,
                    '","received_at":"', {_utc('received_us', d)}, '","schema_version":1,"score":',
                    CASE WHEN score IS NULL THEN 'null' ELSE CAST(round(score, 6) AS {text}) END,
                    ',"terminal_id":"', terminal_id, '","transaction_id":"', transaction_id,
                    CASE WHEN txn_id % 89 = 7 THEN '","extra":"1' ELSE '' END, '"}}') AS value
                  FROM payloads) p""",
        "partitions": """
            SELECT CASE WHEN terminal_key % 4 = 0 THEN 'replay' ELSE 'live' END AS topic, terminal_key AS partition_id, count(*) AS end_offset,
                   CASE WHEN terminal_key % 9 = 0 THEN NULL ELSE count(*) - terminal_key % 7 END AS committed_offset,
                   max(received_us) AS fetched_us
            FROM txn GROUP BY terminal_key""",
        # Load runs and their figures, one per customer row.
        "runs": """
            SELECT c_mktsegment AS model, c_nationkey % 2 = 0 AS stats_on, c_custkey AS run_id,
                   abs(c_acctbal) / 90 AS p95, abs(c_acctbal) / 45 AS p99,
                   CAST(90 + c_custkey % 20 AS DOUBLE) AS rps, c_custkey % 10 AS failed, CAST(6000 AS BIGINT) AS scheduled
            FROM customer""",
        "jobs": """
            SELECT o_orderpriority AS namespace, o_orderkey * 10 AS start_offset, o_custkey % 10 AS sent,
                   CASE WHEN o_orderkey % 41 = 0 THEN 503 WHEN o_orderkey % 7 = 0 THEN 200 ELSE 201 END AS status,
                   CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS score, o_orderstatus AS action
            FROM orders""",
        # Two copies of one table as text; the second has a few other cells.
        "copy_a": f"""
            SELECT o_orderkey AS k, {fmt}('%.2f', o_totalprice) AS price, o_orderstatus AS status,
                   CAST(o_custkey AS {text}) AS cust FROM orders""",
        "copy_b": f"""
            SELECT o_orderkey AS k, CASE WHEN o_orderkey % 500 = 0 THEN concat({fmt}('%.2f', o_totalprice), '0')
                                         WHEN o_orderkey % 1000 = 1 THEN {fmt}('%.2f', o_totalprice + 1)
                                         ELSE {fmt}('%.2f', o_totalprice) END AS price,
                   CASE WHEN o_orderkey % 777 = 0 THEN 'X' ELSE o_orderstatus END AS status,
                   CAST(o_custkey AS {text}) AS cust FROM orders""",
        "shops": "SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 10000 AS DOUBLE) / 100.0 AS x, CAST((s_suppkey * 104729) % 10000 AS DOUBLE) / 100.0 AS y FROM supplier",
        "homes": "SELECT c_custkey AS id, CAST((c_custkey * 7919 + 13) % 10000 AS DOUBLE) / 100.0 AS x, CAST((c_custkey * 104729 + 7) % 10000 AS DOUBLE) / 100.0 AS y FROM customer",
        "calendar": f"""
            SELECT DISTINCT terminal_key, event_us {d['div']} 86400000000 AS day FROM txn
            WHERE (terminal_key * 31 + (event_us {d['div']} 86400000000) * 17) % 43 = 0""",
        # Labelled and scored rows; scores have four digits, so many of them are equal.
        "scored": f"""
            SELECT txn_id AS position, customer_key, terminal_key, amount_minor, event_us,
                   received_us AS decision_us, event_us + (label_us - event_us) {d['div']} 10 AS label_us,
                   is_fraud, fraud_s1, fraud_s2, fraud_s3,
                   CAST(((amount_minor * 1000) {d['div']} (amount_minor + 5000)) * 6 + ((txn_id * 7919) % 1000) * 3
                        + CASE WHEN is_fraud THEN 700 ELSE 0 END AS DOUBLE) / CAST(10000 AS DOUBLE) AS score
            FROM txn""",
        # The same rows scored by several configurations of three families.
        "models": f"""
            SELECT position, amount_minor, decision_us, label_us, is_fraud, fraud_s1, fraud_s2, fraud_s3,
                   family, config,
                   CAST(((amount_minor * 1000) {d['div']} (amount_minor + 5000)) * wa + ((position * 7919) % 1000) * wb
                        + CASE WHEN is_fraud THEN wc ELSE 0 END AS DOUBLE) / CAST(10000 AS DOUBLE) AS score
            FROM {per_model} x""",
        "raw": f"""
            SELECT event_id AS txn_id, user_id AS customer_key, {d['k']} AS terminal_key,
                   CAST(round(value * 100) AS BIGINT) AS amount_minor, {d['us']} AS event_us
            FROM events""",
        "txn": f"""
            SELECT txn_id, customer_key, terminal_key, amount_minor, event_us, received_us,
                   fraud_s1, fraud_s2, fraud_s3, is_fraud,
                   event_us + (CASE WHEN is_fraud THEN 1 + (txn_id * 104729) % 29 ELSE 30 END)
                              * CAST(86400000000 AS BIGINT) AS label_us,
                   CAST(amount_minor AS DOUBLE) / CAST(amount_minor + 5000 AS DOUBLE) AS score
            FROM (SELECT *, fraud_s1 OR fraud_s2 OR fraud_s3 AS is_fraud FROM (
                SELECT *, event_us + CASE WHEN txn_id % 50 = 0
                              THEN ((txn_id * 7919) % 21600) * 1000000 ELSE 200000 END AS received_us,
                       amount_minor > 12000 AS fraud_s1, terminal_key % 50 = 7 AS fraud_s2,
                       customer_key % 40 = 3 AND txn_id % 3 = 0 AS fraud_s3
                FROM raw) a) b""",
        # The same rows with the names and text identifiers the feature operators use.
        "history": f"""
            SELECT *, {hashed} AS payload_hash, event_id AS source_id FROM (
                SELECT txn_id AS seq, {fmt}('TX%09d', txn_id) AS event_id,
                       {fmt}('C%06d', customer_key) AS customer_id,
                       {fmt}('T%06d', terminal_key) AS terminal_id,
                       amount_minor, event_us, received_us
                FROM txn) h""",
        # First deliveries, redeliveries, payload and source conflicts, stolen sources.
        "deliveries": f"""
            SELECT seq, event_id, customer_id, terminal_id, amount_minor, event_us, received_us,
                   {hashed} AS payload_hash, source_id
            FROM ({repeated}) u""",
        # The same, with some events so old that they fall behind the horizon.
        "late_deliveries": """
            SELECT seq, event_id, customer_id, terminal_id, amount_minor,
                   CASE WHEN seq % 401 = 0 AND seq > 0 THEN event_us - CAST(45 AS BIGINT) * 86400000000 ELSE event_us END
                       AS event_us,
                   received_us, payload_hash, source_id
            FROM deliveries""",
        "decisions": f"""
            SELECT txn_id, transaction_id, customer_id, terminal_id, amount_minor, 'USD' AS currency,
                   event_us, received_us, received_us AS decision_us, received_us + 3000 AS persisted_us,
                   score, action, {reasons} AS reason_codes,
                   concat('model-', CAST(txn_id % 2 AS {text})) AS model_version, 'f1' AS feature_version,
                   concat('pol-', CAST(txn_id % 2 AS {text})) AS policy_version,
                   CASE WHEN txn_id % 11 = 0 THEN NULL ELSE concat('scorer/', CAST(1 + txn_id % 2 AS {text})) END
                       AS model_registry_ref
            FROM (SELECT *, CASE WHEN score IS NULL THEN 'review' WHEN score >= CAST({DECLINE_AT} AS DOUBLE) THEN 'decline'
                                 WHEN score >= CAST({REVIEW_AT} AS DOUBLE) THEN 'review' ELSE 'approve' END AS action,
                         CASE WHEN score IS NULL THEN 'NO_SCORE'
                              WHEN score >= CAST({DECLINE_AT} AS DOUBLE) THEN 'SCORE_AT_OR_ABOVE_DECLINE_THRESHOLD'
                              WHEN score >= CAST({REVIEW_AT} AS DOUBLE) THEN 'SCORE_AT_OR_ABOVE_REVIEW_THRESHOLD'
                              ELSE 'SCORE_BELOW_REVIEW_THRESHOLD' END AS rule
                  FROM (SELECT txn_id, {fmt}('TX%09d', txn_id) AS transaction_id,
                               {fmt}('C%06d', customer_key) AS customer_id,
                               {fmt}('T%06d', terminal_key) AS terminal_id, amount_minor, event_us, received_us,
                               CASE WHEN txn_id % 29 = 0 THEN NULL ELSE score END AS score
                        FROM txn) a) b""",
        "outbox": """
            SELECT txn_id + 1 AS id, concat('evt-', transaction_id) AS event_id,
                   transaction_id AS aggregate_id, 'decision.made' AS event_type,
                   received_us + 5000 AS created_us,
                   CASE WHEN txn_id % 97 = 0 THEN NULL
                        ELSE received_us + 25000 + (txn_id * 7919) % 400000 END AS published_us,
                   CASE WHEN txn_id % 10 = 0 THEN 'replay:r1' ELSE 'live' END AS stream
            FROM decisions WHERE txn_id % 61 <> 0""",
        "reviews": f"""
            SELECT d.txn_id * 2 + d.k AS id, d.transaction_id,
                   CASE WHEN d.k = 0 THEN 'in_review' ELSE 'closed' END AS status,
                   CASE WHEN d.k = 1 THEN CASE WHEN d.txn_id % 2 = 0 THEN 'suspected_fraud'
                                               ELSE 'likely_legitimate' END END AS disposition,
                   CAST(NULL AS {text}) AS note,
                   concat('analyst_', CAST(d.txn_id % 7 AS {text})) AS analyst,
                   d.received_us + (d.k + 1) * CAST(3600000000 AS BIGINT) AS created_us
            FROM {reviewed}""",
    }


TABLES = _tables(SPARK)
DUCK_TABLES = _tables(DUCK)
_NEEDS = {
    "raw": ["events"],
    "events": [],
    "orders": [],
    "customer": [],
    "supplier": [],
    "txn": ["raw"],
    "health": ["txn"],
    "served": ["txn"],
    "counted": ["served"],
    "scrapes": ["counted"],
    "payloads": ["decisions"],
    "messages": ["payloads"],
    "partitions": ["txn"],
    "runs": ["customer"],
    "jobs": ["orders"],
    "copy_a": ["orders"],
    "copy_b": ["orders"],
    "shops": ["supplier"],
    "homes": ["customer"],
    "calendar": ["txn"],
    "scored": ["txn"],
    "models": ["scored"],
    "history": ["txn"],
    "deliveries": ["history"],
    "late_deliveries": ["deliveries"],
    "decisions": ["txn"],
    "outbox": ["decisions"],
    "reviews": ["decisions"],
}


def _closure(names: tuple[str, ...], needs: dict[str, list[str]]) -> list[str]:
    out: list[str] = []
    for name in names:
        for inner in [*_closure(tuple(needs[name]), needs), name]:
            if inner not in out:
                out.append(inner)
    return out


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table of this module, planned lazily over the given tables."""
    prepare(spark)
    steps = []
    for step in _closure((name,), _NEEDS):
        if step in TABLES:
            steps.append((step, TABLES[step]))
            continue
        view = f"given_{step}_{zlib.crc32(folder.encode()):x}"
        spread(source(spark, folder, step)).createOrReplaceTempView(view)
        steps.append((step, f"SELECT * FROM {view}"))
    head = ",\n".join(f"{step} AS ({text})" for step, text in steps)
    return spark.sql(f"WITH {head}\nSELECT * FROM {name}")


def with_tables(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """Oracle SQL: the derived tables as CTEs in front of `body`."""
    steps = [(n, DUCK_TABLES[n]) for n in _closure(names, _NEEDS) if n in DUCK_TABLES] + list((extra or {}).items())
    head = ",\n".join(f"{name} AS ({text})" for name, text in steps)
    return f"WITH {head}\n{body}"
