"""Queries that run streams over files of the given tables until all of them are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate import schemas
from tidegate.catalog.base import query
from tidegate.catalog.pit import _STATUS, feature_sql
from tidegate.catalog.state import _LATE
from tidegate.fixtures import load
from tidegate.operators import messages as msg
from tidegate.operators.features import FEATURES
from tidegate.session import scratch, written
from tidegate.sources import readers
from tidegate.streaming.identity import identity_statuses
from tidegate.streaming.pipeline import Pipeline, activity_stream, first_deliveries, run_to_table

_REASON = """CASE txn_id % 89 WHEN 1 THEN 'MALFORMED_JSON' WHEN 2 THEN 'SCHEMA_VIOLATION' WHEN 3 THEN 'UNSUPPORTED_CURRENCY'
             WHEN 4 THEN 'KEY_MISMATCH' WHEN 5 THEN 'HEADER_MISMATCH' WHEN 6 THEN 'PAYLOAD_HASH_MISMATCH' WHEN 7 THEN 'SCHEMA_VIOLATION' END"""


def _messages(spark, folder):
    """The messages table in the layout of a topic."""
    rows = load(spark, folder, "messages")

    def header(name, value):
        return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))

    headers = F.array(
        header("event_id", F.col("event_id")), header("event_type", F.col("header_type")), header("schema_version", F.lit("1"))
    )
    return rows.select(
        F.col("key_text").cast("binary").alias("key"),
        F.col("value_text").cast("binary").alias("value"),
        headers.alias("headers"),
        F.lit("decision.made").alias("topic"),
        F.pmod("txn_id", F.lit(6)).cast("int").alias("partition"),
        F.expr("txn_id div 6").alias("offset"),  # offsets start anew in each partition
    )


@query("str1_parse_messages", f"SELECT CAST(txn_id % 6 AS INTEGER) AS partition, txn_id // 6 AS \"offset\", {_REASON} AS reason FROM messages", ("messages",))
def str1(spark, folder):
    """STR-1: every message with the reason to refuse it, if there is one."""
    return msg.parse(_messages(spark, folder)).select("partition", "offset", "reason")


@query(
    "str1_valid_events",
    f"SELECT transaction_id AS event_id, customer_id, terminal_id, amount_minor, event_us, received_us, payload_hash, event_id AS source_id FROM payloads WHERE {_REASON} IS NULL",
    ("payloads",),
)
def str1_valid(spark, folder):
    """STR-1: valid messages as feature history."""
    return msg.to_history(msg.parse(_messages(spark, folder)), msg.delivery()).drop("seq")


_AGAIN = 1_000_000  # what redelivered messages add to their offset


@query(
    "str1_redelivered_messages",
    f"""SELECT CAST(txn_id % 6 AS INTEGER) AS partition, txn_id // 6 AS "offset", 'applied' AS status FROM messages WHERE {_REASON} IS NULL AND txn_id % 3 <> 0
        UNION ALL SELECT CAST(txn_id % 6 AS INTEGER), txn_id // 6 + {_AGAIN}, CASE WHEN txn_id % 3 <> 0 THEN 'duplicate' ELSE 'applied' END FROM messages WHERE {_REASON} IS NULL""",
    ("messages",),
)
def str1_again(spark, folder):
    """STR-1, STR-2, STATE-1: two batches of six partitions; the second repeats the first. One status a message."""
    pipeline = Pipeline(spark, scratch(spark, "messages"), with_features=False)
    rows = written(_messages(spark, folder).withColumn("_id", F.col("partition") + 6 * F.col("offset")), "topic", "zstd")
    pipeline.on_messages(rows.filter("_id % 3 <> 0").drop("_id"), 0)
    pipeline.on_messages(rows.withColumn("offset", F.col("offset") + _AGAIN).drop("_id"), 1)
    done = pipeline.table("statuses")
    place = F.shiftright("seq", 47)
    return done.select(place.cast("int").alias("partition"), (F.col("seq") - F.shiftleft(place, 47)).alias("offset"), "status")


@query(
    "sink5_refused_by_status",
    f"""SELECT CAST(txn_id % 6 AS INTEGER) AS partition, coalesce({_REASON}, 'event_id_conflict') AS reason, md5(value_text) AS value
        FROM messages WHERE {_REASON} IS NOT NULL OR txn_id % 4 = 0""",
    ("messages",),
)
def sink5_statuses(spark, folder):
    """SINK-5: messages whose status refuses them are kept as they came, beside those refused by their form."""
    pipeline = Pipeline(spark, scratch(spark, "refused"), with_features=False)
    rows = _messages(spark, folder).checkpoint()
    # The same transactions were applied before from other sources.
    earlier = msg.to_history(msg.parse(rows), msg.delivery()).filter((F.shiftright("seq", 47) + 6 * F.expr("seq & 140737488355327")) % 4 == 0)
    pipeline.on_events(earlier.withColumns({"source_id": F.concat(F.lit("other-"), "source_id"), "received_us": F.col("received_us") - 1}), 0)
    pipeline.on_messages(rows, 1)
    partition = F.filter("headers", lambda h: h["key"] == "source_partition")[0]["value"].cast("string").cast("int")
    return pipeline.table("dead_letters").select(partition.alias("partition"), "reason", F.md5("value").alias("value"))


@query(
    "sink4_outbox_publish",
    """SELECT customer_id AS key, concat('{"action":"', action, '","amount_minor":', CAST(amount_minor AS VARCHAR), ',"currency":"USD","customer_id":"', customer_id,
         '","decision_time":"', strftime(make_timestamp(decision_us), '%Y-%m-%dT%H:%M:%S.%fZ'), '","event_id":"', event_id,
         '","event_time":"', strftime(make_timestamp(event_us), '%Y-%m-%dT%H:%M:%S.%fZ'), '","event_type":"decision.made","feature_version":"f1","model_version":"', model_version,
         '","payload_hash":"', payload_hash, '","persisted_at":"', strftime(make_timestamp(persisted_us), '%Y-%m-%dT%H:%M:%S.%fZ'), '","policy_version":"', policy_version,
         '","received_at":"', strftime(make_timestamp(received_us), '%Y-%m-%dT%H:%M:%S.%fZ'), '","schema_version":1,"score":',
         CASE WHEN score IS NULL THEN 'null' ELSE CAST(greatest(round(score, 6), CAST(0.001 AS DOUBLE)) AS VARCHAR) END,
         ',"terminal_id":"', terminal_id, '","transaction_id":"', transaction_id, '"}') AS value FROM payloads""",
    ("payloads",),
)
def sink4(spark, folder):
    """SINK-4, IDEM-2: key and value of the messages to publish."""
    # Below a thousandth the two engines spell a number differently.
    score = F.when(F.col("score").isNotNull(), F.greatest(F.round("score", 6), F.lit(0.001)))
    rows = load(spark, folder, "payloads").withColumns(
        {"currency": F.lit("USD"), "feature_version": F.lit("f1"), "score": score}
    )
    out = msg.to_messages(rows)
    return out.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("src4_event_stream", f"SELECT {_REASON} AS reason, count(*) AS n FROM messages GROUP BY 1", ("messages",))
def src4(spark, folder):
    """SRC-4: the message stream, parsed while it is read."""
    path = scratch(spark, "topic")
    _messages(spark, folder).write.parquet(f"{path}/in")
    run_to_table(msg.parse(readers.message_files(spark, f"{path}/in")).select("offset", "reason"), path)
    return spark.read.parquet(f"{path}/out").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink5_dead_letters",
    f"SELECT CAST(txn_id // 6 AS VARCHAR) AS source_offset, {_REASON} AS reason FROM messages WHERE {_REASON} IS NOT NULL",
    ("messages",),
)
def sink5(spark, folder):
    """SINK-5: refused messages of a stream, with the coordinates they came from."""
    path = scratch(spark, "dead")
    _messages(spark, folder).write.parquet(f"{path}/in")
    run_to_table(msg.dead_letters(msg.parse(readers.message_files(spark, f"{path}/in"))), path)
    offset = F.filter("headers", lambda h: h["key"] == "source_offset")[0]["value"].cast("string")
    return spark.read.parquet(f"{path}/out").select(offset.alias("source_offset"), "reason")


def _in_parts(spark, folder, pipeline, parts=2, table="deliveries"):
    """Deliveries appended in arrival order; the stream is started again after each part."""
    rows = written(load(spark, folder, table).select(*schemas.TXN_EVENT.fieldNames()), "arrivals")
    inbox = pipeline.path("inbox")
    cuts = rows.approxQuantile("received_us", [i / parts for i in range(1, parts)], 0.001)
    low = None
    for cut in [*cuts, None]:
        part = rows
        if low is not None:
            part = part.filter(F.col("received_us") > int(low))
        if cut is not None:
            part = part.filter(F.col("received_us") <= int(cut))
        part.write.mode("append").parquet(inbox)
        pipeline.run(spark.readStream.schema(schemas.TXN_EVENT).parquet(inbox), pipeline.on_events)
        low = cut
    return pipeline


@query(
    "str2_streaming_features",
    f"SELECT seq, decision_us, {', '.join(FEATURES)}, TRUE AS history_complete FROM f",
    ("deliveries",),
    {**_STATUS, "f": feature_sql("statuses", applied="status = 'applied'")},
)
def str2(spark, folder):
    """STR-2, STATE-8: features of a stream, equal to the batch result when it arrives in order."""
    done = _in_parts(spark, folder, Pipeline(spark, scratch(spark, "stream")))
    return done.table("features").select("seq", "decision_us", *FEATURES, "history_complete")


@query("state1_streaming_statuses", "SELECT seq, status FROM statuses", ("deliveries",), _STATUS)
def state1_stream(spark, folder):
    """STATE-1 on a stream that is stopped and started again."""
    done = _in_parts(spark, folder, Pipeline(spark, scratch(spark, "apply"), with_features=False))
    return done.table("statuses").select("seq", "status")


@query("str3_repeated_batch", "SELECT count(*) AS rows, count(DISTINCT seq) AS distinct_rows, count(*) FILTER (WHERE status = 'applied') AS applied FROM statuses", ("deliveries",), _STATUS)
def str3(spark, folder):
    """STR-3: a batch that is handled twice, as after a failure before its commit, counts once."""
    pipeline = Pipeline(spark, scratch(spark, "twice"), with_features=False)
    rows = load(spark, folder, "deliveries").checkpoint()
    pipeline.on_events(rows, 0)
    pipeline.on_events(rows, 0)
    return pipeline.table("statuses").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("seq").alias("distinct_rows"), F.count_if(F.col("status") == "applied").alias("applied")
    )


@query("state7_identity_timers", "SELECT seq, event_id, status FROM statuses", ("late_deliveries",), _LATE)
def state7_timers(spark, folder):
    """STATE-2, STATE-4, STATE-7 on a stream: late deliveries get a status, identities leave with the horizon."""
    path = scratch(spark, "identity")
    rows = load(spark, folder, "late_deliveries").select(*schemas.TXN_EVENT.fieldNames())
    rows.write.parquet(f"{path}/in")
    return identity_statuses(spark, spark.readStream.schema(schemas.TXN_EVENT).parquet(f"{path}/in"), path)


@query("state4_streaming_late", "SELECT seq, status FROM statuses", ("late_deliveries",), _LATE)
def state4_stream(spark, folder):
    """STATE-4: the same over batches, where the horizon is that of all batches before."""
    done = _in_parts(spark, folder, Pipeline(spark, scratch(spark, "late"), with_features=False), table="late_deliveries")
    return done.table("statuses").select("seq", "status")


@query(
    "state8_streaming_snapshot",
    """SELECT customer_id, count(*) AS applied_count, max(received_us) AS last_applied_us, max_by(event_id, CAST(received_us AS HUGEINT) * 1000000 + seq) AS last_event_id
       FROM statuses WHERE status = 'applied' GROUP BY customer_id""",
    ("deliveries",),
    _STATUS,
)
def state8_stream(spark, folder):
    """STATE-8: the latest state of every customer, from what each micro-batch adds."""
    return _in_parts(spark, folder, Pipeline(spark, scratch(spark, "snapshot"), with_features=False), parts=3).snapshot()


@query(
    "state8_folded_snapshot",
    """SELECT customer_id, count(*) AS applied_count, max(received_us) AS last_applied_us, max_by(event_id, CAST(received_us AS HUGEINT) * 1000000 + seq) AS last_event_id
       FROM statuses WHERE status = 'applied' GROUP BY customer_id""",
    ("deliveries",),
    _STATUS,
)
def state8_folded(spark, folder):
    """STATE-8: the same where batches fold what earlier ones left, so that a snapshot reads few folders."""
    return _in_parts(spark, folder, Pipeline(spark, scratch(spark, "snapshot"), with_features=False, fold_after=2), parts=5).snapshot()


@query(
    "str7_replay_isolation",
    """SELECT namespace, status, count(*) AS n FROM (SELECT 'live' AS namespace, status FROM statuses UNION ALL SELECT 'replay:r1', status FROM statuses) x GROUP BY ALL""",
    ("deliveries",),
    _STATUS,
)
def str7(spark, folder):
    """STR-7: a replay of the live deliveries finds a state of its own, and leaves the live one as it was."""
    base, rows = scratch(spark, "namespaces"), load(spark, folder, "deliveries").checkpoint()
    out = None
    for name in ("live", "replay:r1"):
        pipeline = Pipeline(spark, base, name, with_features=False)
        pipeline.on_events(rows, 0)
        part = pipeline.table("statuses").select(F.lit(name).alias("namespace"), "status")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("namespace", "status").agg(F.count(F.lit(1)).alias("n"))


@query("state2_first_deliveries", "SELECT DISTINCT event_id FROM deliveries", ("deliveries",))
def state2_stream(spark, folder):
    """STATE-2: duplicates dropped within the watermark, where their status is not needed."""
    path = scratch(spark, "first")
    rows = load(spark, folder, "deliveries").select("event_id", F.timestamp_micros("event_us").alias("event_time"))
    rows.write.parquet(f"{path}/in")
    run_to_table(first_deliveries(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), path)
    return spark.read.parquet(f"{path}/out").select("event_id")


@query(
    "str4_streaming_activity",
    """SELECT decision_us - decision_us % 900000000 AS bucket_us, count(*) AS total, count(*) FILTER (WHERE action = 'approve') AS approve,
              count(*) FILTER (WHERE action = 'review') AS review, count(*) FILTER (WHERE action = 'decline') AS decline,
              count(*) FILTER (WHERE score IS NULL) AS scoreless
       FROM decisions GROUP BY 1 HAVING decision_us - decision_us % 900000000 + 900000000 <= (SELECT max(decision_us) // 1000 * 1000 - 3600000000 FROM decisions)""",
    ("decisions",),
)
def str4(spark, folder):
    """STR-4: activity per closed window of a stream."""
    path = scratch(spark, "activity")
    rows = load(spark, folder, "decisions").select(F.timestamp_micros("decision_us").alias("decision_time"), "action", "score")
    rows.write.parquet(f"{path}/in")
    run_to_table(activity_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), path)
    return spark.read.parquet(f"{path}/out")


@query(
    "sink6_append_reviews",
    "SELECT status, count(*) AS n, 'DISPOSITION_REQUIRED' AS refused FROM reviews GROUP BY status",
    ("reviews",),
)
def sink6(spark, folder):
    """SINK-6: reviews are appended in two steps; a bad one is refused as a whole."""
    from tidegate.sources import sinks

    path = scratch(spark, "reviews")
    reviews, decisions = load(spark, folder, "reviews"), load(spark, folder, "decisions")
    sinks.append_reviews(reviews.filter("status = 'in_review'"), decisions, path)
    sinks.append_reviews(reviews.filter("status = 'closed'"), decisions, path)
    try:
        sinks.append_reviews(reviews.withColumn("status", F.lit("closed")).withColumn("disposition", F.lit(None).cast("string")), decisions, path)
        refused = "nothing"
    except sinks.InvalidReview as exc:
        refused = str(exc)
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))
