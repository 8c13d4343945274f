"""Scoring texts by the hashed maximum-entropy model, beside a smoothed word-frequency base."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import bounded, fifth, fold, map_batches, shared_partitions, written
from tidegate.llm.maxent import BLOCK, OUTPUTS, RARE, Lexicon, Model, Trainer, log_shares

#: A word is common if it is at least 1 of so many training tokens, so no more words than this are common.
COMMON = 1 << 21
#: Parts of the training texts that are learned one after another, each from the average of the one before.
ROUNDS = 2
#: Texts handled at a time.
SLICE = 256

_lexicons: dict[int, tuple] = {}


def lexicon(owner: object) -> tuple[Lexicon, dict]:
    """The worker's words for a broadcast value, with arrays that are filled as words come."""
    if id(owner) not in _lexicons:
        _lexicons.clear()
        _lexicons[id(owner)] = (Lexicon(), {}, owner)
    return _lexicons[id(owner)][:2]


def counted(texts: DataFrame) -> DataFrame:
    """(code, rare, n): how often each token occurs in the texts, summed in the task first."""

    def each(batch: pa.RecordBatch) -> dict:
        known, _ = lexicon(counted)
        column, parts, total = batch.column(0).to_pylist(), [], np.zeros(0, np.int64)

        def leave() -> None:
            hit = np.nonzero(total)[0]
            parts.append((known.code[hit], known.group[hit], total[hit]))

        for i in range(0, len(column), SLICE):
            if len(known) > known.most:  # the next call starts anew
                leave()
                total = np.zeros(0, np.int64)
            numbers, _ = known.numbers(column[i : i + SLICE])
            if len(known) > len(total):
                total = np.append(total, np.zeros(2 * len(known) - len(total), np.int64))
            np.add.at(total, numbers, 1)
        leave()
        return dict(zip(("code", "rare", "n"), (np.concatenate(x) for x in zip(*parts))))

    parts = map_batches(texts, each, "code bigint, rare int, n bigint")
    return parts.groupBy("code").agg(F.first("rare").alias("rare"), F.sum("n").alias("n"))


def trained(texts: DataFrame, model: Model, tasks: int) -> Model:
    """The model after one pass over the texts: every task trains its own copy on its texts, and each row of
    the tables becomes the mean of the copies, weighted by how often they updated it."""
    shown = texts.sparkSession.sparkContext.broadcast(model)
    blocks = [len(w) // BLOCK for w in (model.class_w, model.word_w)]
    schema = pa.schema([("block", pa.int32()), ("part", pa.binary())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, any_text = Trainer(shown.value), False
        known, held = lexicon(shown.value)
        for batch in batches:
            column = batch.column(0).to_pylist()
            for i in range(0, len(column), SLICE):
                numbers, sizes = known.numbers(column[i : i + SLICE])
                trainer.learn(_outputs(shown.value, known, held)[numbers], sizes)
                any_text = True
        if any_text:
            weights = np.concatenate([trainer.model.class_w, trainer.model.word_w])
            updates = np.concatenate(trainer.updates).astype(np.float32)
            sums = np.concatenate([weights * updates[:, None], updates[:, None]], axis=1).astype("<f4")
            hit = [b for b in range(sum(blocks)) if updates[b * BLOCK : (b + 1) * BLOCK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array([sums[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in hit], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[block] = total.get(block, 0.0) + np.frombuffer(part, "<f4").astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.astype("<f4").tobytes() for t in total.values()], pa.binary())], schema=schema)

    parts = bounded(texts).mapInArrow(learn, "block int, part binary")
    sums = written(parts.repartition(tasks, "block").mapInArrow(add, "block int, part binary"), "weights").toArrow()
    weights = np.concatenate([model.class_w, model.word_w])
    for block, part in zip(sums["block"].to_pylist(), sums["part"].to_pylist()):
        rows = np.frombuffer(part, "<f4").reshape(BLOCK, -1)
        hit = rows[:, -1] > 0
        weights[block * BLOCK : (block + 1) * BLOCK][hit] = rows[hit, :-1] / rows[hit, -1:]
    return Model(model.codes, model.outputs, weights[: len(model.class_w)].copy(), weights[len(model.class_w) :].copy())


def _outputs(model: Model, known: Lexicon, held: dict) -> np.ndarray:
    """The model's output of each word of a lexicon, kept while no new words come."""
    if held.get("era") != known.era:
        held.clear()
        held["era"] = known.era
    at = len(held.get("outputs", ()))
    if at < len(known.code):
        new = model.outputs_of(known.code[at:], known.group[at:])
        held["outputs"] = np.append(held["outputs"], new) if at else new
    return held["outputs"]


class Scorer:
    """What scoring a text needs: the model, the common words' counts, and the totals."""

    def __init__(self, model: Model, codes: np.ndarray, counts: np.ndarray, mass: np.ndarray, kinds: np.ndarray, tokens: int, words: int):
        order = np.argsort(codes)
        self.model, self.codes, self.counts = model, codes[order], counts[order]
        self.rest = np.log10(mass + 0.5 * (kinds + 1))  # by rare group
        self.tokens, self.base = tokens, math.log10(tokens + 0.5 * (words + 1))

    def count_of(self, code: np.ndarray) -> np.ndarray:
        """Training counts of words, 0 of those that are not common."""
        if not len(self.codes):
            return np.zeros(len(code), np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.counts[at], 0)

    def parts(self, texts: list[str]) -> dict:
        """By text, what is known without the rare words' counts, and the rare words with their numbers."""
        known, held = lexicon(self)
        numbers, sizes = known.numbers(texts)
        outputs = _outputs(self.model, known, held)
        if len(held.get("counts", ())) != len(known.code):
            at = len(held.get("counts", ()))
            held["counts"] = np.append(held.get("counts", np.zeros(0, np.int64)), self.count_of(known.code[at:]))
        out, count = outputs[numbers], held["counts"][numbers]
        owner = np.repeat(np.arange(len(texts)), sizes)
        common = count > 0
        share = np.log10(count + 0.5)

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=values, minlength=len(texts))

        grouped = out < RARE
        model = log_shares(self.model, out, sizes) - np.where(grouped, self.rest[np.minimum(out, RARE - 1)], 0.0)
        model += np.where(grouped & common, share, 0.0)
        code, shared = known.code[numbers[~common]], grouped[~common]
        ends = np.cumsum(np.bincount(owner[~common], minlength=len(texts)))[:-1]
        rare = [np.unique(c, return_index=True, return_counts=True) for c in np.split(code, ends)]
        # Words with an output of their own need no share of a group, whether or not they are common.
        needed = [np.where(g[first], n, 0) for g, (_, first, n) in zip(np.split(shared, ends), rare, strict=True)]
        return {
            "n_tokens": sizes,
            "n_known": total(common).astype(np.int64),
            "base": total(np.where(common, share, 0.0)) - sizes * self.base,
            "model": total(model),
            "codes": [c.tolist() for c, _, _ in rare],
            "times": [n.tolist() for _, _, n in rare],
            "needed": [n.tolist() for n in needed],
        }


def scores(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: key, n_tokens, n_known, train_tokens, base_score, score.

    training: a condition on the column "key" (the key) that says which documents are learned from, all of them
    and whole. base_score is the log10 probability by smoothed frequencies of all training words, score the
    model's. Common words' counts are broadcast, at most COMMON of them whatever the corpus; those of all
    other words are joined. Null and empty texts are one token, the end; repeated rows stay, null keys too;
    without training texts both scores rest on smoothing alone; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), fold(text).alias("text"))
    learned = rows.where(F.coalesce(training, F.lit(False))).select("text")
    counts = written(counted(learned), "counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, words = totals["n"] or 0, totals["v"]
    most = counts.orderBy(F.desc("n"), "code").limit(OUTPUTS - RARE)
    top = most.select("code", "n").toArrow()
    least = max(1, math.ceil(tokens / COMMON))
    common = counts.where(F.col("n") >= least).select("code", "n").toArrow()
    groups = counts.join(F.broadcast(most.select("code")), "code", "left_anti").groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(RARE), np.zeros(RARE)
    for g in groups:
        mass[g["rare"]], kinds[g["rare"]] = g["n"], g["v"]
    model = Model.of_counts(top["code"].to_numpy(), top["n"].to_numpy().astype(float), mass)
    for part in range(rounds):
        model = trained(learned.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == part), model, shared_partitions(spark))
    scorer = spark.sparkContext.broadcast(Scorer(model, common["code"].to_numpy(), common["n"].to_numpy(), mass, kinds, tokens, words))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, row bigint, n_tokens bigint, n_known bigint, base double, model double, codes array<bigint>, times array<bigint>, needed array<bigint>"

    def each(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        parts = [scorer.value.parts(texts[i : i + SLICE]) for i in range(0, len(texts), SLICE)]
        return {"key": batch.column(0), "row": batch.column(2), **{c: [x for p in parts for x in p[c]] for c in parts[0]}}

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    seen = written(map_batches(numbered, each, schema), "scored")
    rare = seen.select("row", F.explode(F.arrays_zip("codes", "times", "needed")).alias("w")).select("row", "w.*")
    found = rare.join(counts.where(F.col("n") < least), F.col("codes") == F.col("code"), "left")
    part = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    sums = found.groupBy("row").agg(
        F.sum(F.col("times") * part).alias("share"),
        F.sum(F.col("needed") * part).alias("in_groups"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
    )
    out = seen.drop("codes", "times", "needed").join(sums, "row", "left")
    return out.select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("share", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("in_groups", F.lit(0.0))).alias("score"),
    )


def language_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`scores` learned from documents whose key's crc32 modulo 5 is not 1, with held_out for the others."""
    return scores(docs, fifth("key") != 1, key, text).withColumn("held_out", fifth(key) == 1)
