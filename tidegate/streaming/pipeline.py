"""Micro-batch pipeline: messages in; statuses, features, history and dead letters out.

Each attempt of a batch writes folders of its own, and one commit written last lists them. Readers follow commits:
what an attempt left before it failed is never read, a reader between two writes sees the batches before, and a
batch that is handed over again after its commit is not handled again. A commit also carries the folders of the
history inside the retention horizon, so a batch reads one commit, only history of its own customers and terminals
inside the horizon, and only identities that it mentions. A namespace reads one topic; a message is known by its
partition and offset, as offsets start anew in each partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate import schemas
from tidegate.functions.times import DAY, lit
from tidegate.operators import messages as msg
from tidegate.operators.apply import DEAD_LETTER_STATUSES, apply_events, entity_metadata
from tidegate.operators.features import APPLIED, FEATURES, RETENTION, point_in_time
from tidegate.plans.visibility import MAX_LISTED
from tidegate.session import written as stored

_STORED = T.StructType([*schemas.TXN_EVENT.fields, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("day", T.LongType())])
_COMMIT = (
    "batch bigint, watermark_us bigint, tables array<struct<name: string, folder: string>>, "
    "history array<struct<folder: string, newest_us: bigint>>, entities array<string>"
)


@dataclass(frozen=True)
class Pipeline:
    """State and outputs of one namespace below `base`; another namespace has another folder."""

    spark: SparkSession
    base: str
    namespace: str = "live"
    retention_us: int = RETENTION
    with_features: bool = True
    fold_after: int = 64  # entity folders that a snapshot reads at most; one more, and the batch folds them into one

    def path(self, table: str) -> str:
        return f"{self.base}/{self.namespace.replace(':', '_')}/{table}"

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMIT).option("recursiveFileLookup", True).json(self.path("commits"))
        except AnalysisException:
            return self.spark.createDataFrame([], _COMMIT)

    def commit_of(self, number: int) -> Row | None:
        """The commit of a batch, if it has one."""
        try:
            return self.spark.read.schema(_COMMIT).json(self.path(f"commits/{number:09d}")).first()
        except AnalysisException:
            return None

    def _before(self, number: int) -> Row | None:
        """The newest commit before a batch: that of the batch before it, or what comes nearest."""
        found = self.commit_of(number - 1) if number else None
        return found or self._commits().filter(F.col("batch") < number).orderBy(F.desc("batch")).first()

    def watermark(self, number: int) -> int | None:
        """Newest applied event time before a batch."""
        commit = self._before(number)
        return commit["watermark_us"] if commit else None

    def history(self, before_batch: int, since_us: int | None = None) -> DataFrame:
        """Applied events of earlier batches inside the horizon; days before `since_us` are not read."""
        commit = self._before(before_batch)
        live = [h["folder"] for h in (commit["history"] if commit else []) if since_us is None or h["newest_us"] >= since_us]
        if not live:
            return self.spark.createDataFrame([], _STORED).drop("attempt")
        stored = self.spark.read.schema(_STORED).option("basePath", self.path("history")).parquet(*live).drop("attempt")
        if since_us is None:
            return stored
        return stored.filter((F.col("day") >= since_us // DAY) & (F.col("event_us") >= since_us))

    def table(self, name: str) -> DataFrame:
        """A table of all committed batches."""
        listed = self._commits().select(F.explode("tables").alias("t")).filter(F.col("t.name") == name)
        folders = [r[0] for r in listed.select("t.folder").collect()]
        if not folders:
            raise ValueError(f"no committed batch has a table {name}")
        return self.spark.read.parquet(*folders)

    def _put(self, written: dict[str, str], name: str, df: DataFrame, number: int, by: str | None = None) -> None:
        """Write a table of this attempt; nobody reads it before the commit."""
        folder = self.path(f"{name}/attempt={number:09d}-{uuid.uuid4().hex}")
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(folder, compression="zstd")
        written[name] = folder

    def _commit(self, number: int, written: dict[str, str], watermark: int | None, added_us: int | None) -> None:
        """Make a batch's tables visible. Folders whose events are all behind the horizon leave the history."""
        earlier = self._before(number)
        live = [(h["folder"], h["newest_us"]) for h in (earlier["history"] if earlier else [])]
        if added_us is not None:
            live.append((written["history"], added_us))
        if watermark is not None:
            live = [(folder, newest) for folder, newest in live if newest >= watermark - self.retention_us]
        entities = self._entities(earlier, number, written)
        row = (number, watermark, sorted(written.items()), live, entities)
        out = self.spark.createDataFrame([row], _COMMIT).coalesce(1)
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(self.path(f"commits/{number:09d}"))

    def on_messages(self, batch: DataFrame, number: int) -> None:
        """Apply one batch of messages; what is refused by its form or its status is kept as it came."""
        if self.commit_of(number) is not None:
            return
        written: dict[str, str] = {}
        # Texts are kept of refused messages only; the few that a status refuses are read again from the batch.
        parsed = stored(msg.sorted_out(msg.parse(batch), msg.delivery()), "parsed", "zstd")
        valid = parsed.filter(F.col("reason").isNull()).select(*schemas.TXN_EVENT.fieldNames())
        applied, watermark, added_us = self._apply(valid, number, written)
        letters = msg.letters(parsed)
        if applied is not None:
            refused = self.spark.read.schema(applied.schema).parquet(written["refused"]).select("seq", F.col("status").alias("_status"))
            many = refused.count()
            if many:
                found = batch.withColumn("seq", msg.delivery()).join(F.broadcast(refused) if many <= MAX_LISTED else refused, "seq")
                again = msg.parse(found).filter(F.col("reason").isNull()).withColumn("reason", F.col("_status"))
                letters = letters.unionByName(msg.letters(again))
        self._put(written, "dead_letters", msg.dead_letters(letters), number)
        self._commit(number, written, watermark, added_us)

    def on_events(self, batch: DataFrame, number: int) -> None:
        """Apply one batch of events and compute the features its decisions could see."""
        if self.commit_of(number) is not None:
            return
        written: dict[str, str] = {}
        _, watermark, added_us = self._apply(stored(batch.select(*schemas.TXN_EVENT.fieldNames()), "batch", "zstd"), number, written)
        self._commit(number, written, watermark, added_us)

    def _apply(self, rows: DataFrame, number: int, written: dict[str, str]) -> tuple[DataFrame | None, int | None, int | None]:
        """Write a batch's tables from its stored rows; the rows with their status, the watermark after it, and its
        newest applied event."""
        watermark = self.watermark(number)
        if rows.isEmpty():
            return None, watermark, None
        live = None if watermark is None else watermark - self.retention_us
        # Read by each step that gives statuses, so it is found once.
        prior = stored(self._identities(self.history(number, live), rows), "prior", "zstd")
        both = rows.withColumn("_at", F.col("received_us")).unionByName(prior)
        status = apply_events(both, self.retention_us, F.col("_at"), watermark_us=watermark)
        applied = rows.join(status.filter("_at >= 0").select("seq", "status"), "seq")
        self._put(written, "statuses", applied, number)
        applied = self.spark.read.schema(applied.schema).parquet(written["statuses"])
        self._put(written, "refused", applied.filter(F.col("status").isin(*DEAD_LETTER_STATUSES)), number)
        if self.with_features:
            self._put(written, "features", self._features(number, applied, watermark), number)
        fresh = applied.filter(F.col("status") == APPLIED).drop("status")
        days = fresh.withColumns({"batch": lit(number), "day": F.floor(F.col("event_us") / DAY).cast("bigint")})
        self._put(written, "entities", entity_metadata(applied, "customer_id").withColumn("batch", lit(number)), number)
        self._put(written, "history", days, number, "day")
        newest = fresh.agg(F.max("event_us")).first()[0]
        return applied, max((w for w in (watermark, newest) if w is not None), default=None), newest

    def _entities(self, earlier: Row | None, number: int, written: dict[str, str]) -> list[str]:
        """Folders that together hold the state of all customers after a batch, folded when they are many."""
        folders = list(earlier["entities"] or []) if earlier else []
        if earlier and earlier["entities"] is None:  # the commit of a version that kept no such list
            listed = self._commits().filter(F.col("batch") < number).select(F.explode("tables").alias("t")).filter("t.name = 'entities'")
            folders = [r[0] for r in listed.select("t.folder").collect()]
        if "entities" in written:
            folders.append(written["entities"])
        if len(folders) > self.fold_after:
            self._put(written, "entities_folded", self._folded(self.spark.read.parquet(*folders)), number)
            folders = [written["entities_folded"]]
        return folders

    @staticmethod
    def _folded(added: DataFrame) -> DataFrame:
        """One row per customer of rows that each batch, or an earlier fold, has left."""
        last = F.max(F.struct("last_applied_us", "batch", "last_event_id"))
        out = added.groupBy("customer_id").agg(F.sum("applied_count").alias("applied_count"), last.alias("_last"))
        return out.select("customer_id", "applied_count", "_last.last_applied_us", "_last.last_event_id", "_last.batch")

    def snapshot(self, before_batch: int | None = None) -> DataFrame:
        """The latest state of every customer, or that before a batch: from at most `fold_after` folders."""
        commit = self._before(before_batch) if before_batch is not None else self._commits().orderBy(F.desc("batch")).first()
        folders = list(commit["entities"] or []) if commit else []
        if commit and commit["entities"] is None:
            return self._folded(self.table("entities").filter(F.col("batch") <= commit["batch"])).drop("batch")
        if not folders:
            raise ValueError("no committed batch has customers")
        return self._folded(self.spark.read.parquet(*folders)).drop("batch")

    def _identities(self, history: DataFrame, rows: DataFrame) -> DataFrame:
        """Stored events with an id or source that the batch mentions, ordered before its rows."""
        # Only hashes of ids are dealt; the wide rows follow where they are few.
        def keys(df: DataFrame, *kept: str) -> DataFrame:
            each = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), c)) for c in ("event_id", "source_id")]
            return df.select(*kept, F.explode(F.array_compact(F.array(*each))).alias("_k"))

        found = keys(history, "seq").join(keys(rows).distinct(), "_k", "left_semi").select("seq").distinct().checkpoint()
        found = F.broadcast(found) if found.count() <= MAX_LISTED else found
        return history.join(found, "seq", "left_semi").select(*rows.columns).distinct().withColumn("_at", lit(-1))

    def _features(self, number: int, applied: DataFrame, watermark: int | None) -> DataFrame:
        # Refused rows don't widen the history that is read: a late one is incomplete in any case.
        oldest = applied.agg(F.min(F.when(F.col("status") == APPLIED, F.col("event_us"))), F.max("event_us")).first()
        recent = self.history(number, (oldest[1] if oldest[0] is None else oldest[0]) - self.retention_us)
        mine = self._of_entities(recent, applied, ["customer_id", "terminal_id"])
        known = mine.select(*schemas.TXN_EVENT.fieldNames()).withColumn("status", F.lit(APPLIED))
        both = applied.withColumn("_ask", F.lit(True)).unionByName(known.withColumn("_ask", F.lit(False)))
        seen = point_in_time(both, retention_us=self.retention_us, repeated_ids=True, watermark_us=watermark)
        return seen.filter("_ask").select("seq", "event_id", "decision_us", *FEATURES, "history_complete")

    @staticmethod
    def _of_entities(history: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
        """History rows of which one of the entities `names` occurs in `rows`; long lists are joined, others broadcast."""
        out = history
        for name in names:
            listed = rows.select(F.xxhash64(name).alias(f"_k_{name}")).filter(F.col(name).isNotNull()).distinct()
            listed = listed.withColumn(f"_is_{name}", F.lit(True)).checkpoint()
            key = F.when(F.col(name).isNotNull(), F.xxhash64(name))
            out = out.join(F.broadcast(listed) if listed.count() <= MAX_LISTED else listed, key == F.col(f"_k_{name}"), "left")
        return out.filter(F.coalesce(*[F.col(f"_is_{name}") for name in names], F.lit(False))).select(*history.columns)

    def run(self, stream: DataFrame, handle: Callable[[DataFrame, int], None]) -> None:
        """Process what is available, from where the checkpoint left off."""
        query = (
            stream.writeStream.foreachBatch(handle)
            .option("checkpointLocation", self.path("checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def activity_stream(decisions: DataFrame, step: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Decisions per tumbling window; a window is final once the watermark has passed it."""
    return (
        decisions.withWatermark("decision_time", delay)
        .groupBy(F.window("decision_time", step).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("action") == a).alias(a) for a in ("approve", "review", "decline")],
            F.count_if(F.col("score").isNull()).alias("scoreless"),
        )
        .select(F.unix_micros("w.start").alias("bucket_us"), "total", "approve", "review", "decline", "scoreless")
    )


def first_deliveries(events: DataFrame, delay: str = "31 days") -> DataFrame:
    """One row per event id, where no status of the repetitions is needed."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Write a stream to a folder until what is available has been read."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
