"""Toxicity by class-conditional Kneser-Ney models of how words are spelt.

Each class has its own counts of the next character after up to ORDER - 1 characters of a word; what they do
not know falls back to one Kneser-Ney model of both classes together and, below it, of continuation counts. A rare or unseen
expression so gets evidence from its known beginning, and none from rarity alone. Words whose two likelihoods
are nearly equal say nothing: with a long tail of words their noise would drown the rest. A text's feature is
the root of the difference of the two log-likelihoods by word over its telling words; a logistic curve,
fitted on documents that the counts left out, turns it into a probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import fifth, fold, kept, map_batches, written

#: Characters of a gram: the next one and its context.
ORDER = 8
#: Labelled documents of each class that a model is fitted on, at most.
MOST = 3000
#: Words whose score a worker keeps before it starts anew.
KEPT = 1 << 17
#: Log ratios from which a word is telling; the left-out documents decide which.
TELLING = (3.5, 4.0, 4.5, 5.0)
#: Texts handled at a time.
SLICE = 64
#: Marks before and after a word.
OPEN, CLOSE = "\x02", "\x03"


def mixed(points: np.ndarray, place: int) -> np.ndarray:
    """A random number for each character at a place of a gram, counted from its end."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 0x1000002 * place)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def suffixes(columns: list[np.ndarray]) -> np.ndarray:
    """Codes of the last 1, 2, ... characters; columns[i] holds the character i places before the end."""
    codes = np.empty((len(columns), len(columns[0])), np.uint64)
    for i, column in enumerate(columns):
        codes[i] = mixed(column, i)
        if i:
            codes[i] += codes[i - 1]
    return codes


def spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, context, owner): a code for each character of each word with what precedes it, a code for what
    precedes it alone, and the word."""
    points = np.frombuffer("".join([f"{OPEN}{w}{CLOSE}" for w in words]).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.concatenate([np.zeros(ORDER, np.uint32), points])
    codes = suffixes([padded[ORDER - i : len(padded) - i] for i in range(ORDER)])
    at = np.nonzero(place)[0]
    length = np.minimum(place[at] + 1, ORDER)
    return codes[length - 1, at], codes[length - 2, at - 1], owner[at]


def lookup(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of wanted codes in a sorted table."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return place, table[place] == wanted


def discount(counts: np.ndarray) -> float:
    """Kneser and Ney's estimate from the counts of ones and twos."""
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.1, 0.99))


def shares(context: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated probabilities of grams, with the contexts and the mass that each leaves to the lower order."""
    seen, at = np.unique(context, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(seen))
    kinds = np.bincount(at, weights=counts > 0, minlength=len(seen))
    off = discount(counts[counts > 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(total > 0, off * kinds / total, 1.0)
        own = np.where(total[at] > 0, np.maximum(counts - off, 0) / total[at], 0.0)
    return own + rest[at] * lower, seen, rest


@dataclass
class Model:
    """Log ratios toxic to ordinary, by code: of known grams, and of the masses left by known contexts."""

    gram: np.ndarray
    gram_ratio: np.ndarray
    context: np.ndarray
    context_ratio: np.ndarray
    slope: float = 1.0
    offset: float = -4.0  # without labels of both classes to place the curve, a text is taken as ordinary
    telling: float = TELLING[0]

    def words(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        gram, context, owner = spelt(words)
        at, known = lookup(self.gram, gram)
        before, partly = lookup(self.context, context)
        ratio = np.where(known, self.gram_ratio[at] if len(self.gram) else 0.0, np.where(partly, self.context_ratio[before] if len(self.context) else 0.0, 0.0))
        return np.bincount(owner, weights=ratio, minlength=len(words))

    def probability(self, feature: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * feature + self.offset, -500, 500)))


def fitted(grams: pa.ChunkedArray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The model of grams (up to ORDER characters, the last one predicted) with their counts in either class."""
    if not len(grams):
        empty = np.zeros(0)
        return Model(empty.astype(np.uint64), empty, empty.astype(np.uint64), empty)
    matrix = np.zeros((len(grams), ORDER), np.uint32)
    for at in range(0, len(grams), 1 << 15):
        joined = "".join([g.rjust(ORDER, "\0") for g in grams.slice(at, 1 << 15).to_pylist()])
        matrix[at : at + (1 << 15)] = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    length = (matrix > 0).sum(axis=1)
    columns = [matrix[:, ORDER - 1 - i] for i in range(ORDER)]
    whole, before = suffixes(columns), suffixes(columns[1:])
    kinds = []  # by order: code, context code, continuation count
    for n in range(1, ORDER):
        rows = np.nonzero(length > n)[0]
        _, once = np.unique(whole[n, rows], return_index=True)
        rows = rows[once]
        code, first, count = np.unique(whole[n - 1, rows], return_index=True, return_counts=True)
        kinds.append((code, before[n - 2, rows[first]] if n > 1 else np.zeros(len(code), np.uint64), count))
    lower, known = np.full(len(kinds[0][0]), 1.0 / (len(kinds[0][0]) + 1)), []
    for n, (code, context, count) in enumerate(kinds):
        if n and len(code):
            rows = np.nonzero(length > n + 1)[0]
            _, first = np.unique(whole[n, rows], return_index=True)
            at, _ = lookup(kinds[n - 1][0], whole[n - 1, rows[first]])
            lower = known[n - 1][at]
        known.append(shares(context, count, lower)[0] if len(code) else np.zeros(0))
    code = whole[length - 1, np.arange(len(grams))]
    context = before[np.maximum(length - 2, 0), np.arange(len(grams))]
    shared = np.zeros(len(grams))
    for n in range(1, ORDER):
        rows = np.nonzero(length == n + 1)[0]
        at, _ = lookup(kinds[n - 1][0], whole[n - 1, rows])
        shared[rows] = known[n - 1][at]
    shared, _, _ = shares(context, toxic + ordinary, shared)
    p, seen, left = shares(context, toxic, shared)
    q, _, rest = shares(context, ordinary, shared)
    order = np.argsort(code)
    return Model(code[order], np.log(p / q)[order], seen, np.log(left / rest))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small penalty on the slope in units of the feature's spread."""
    scale = float(np.std(x)) or 1.0
    z, beta = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    ridge = np.array([1e-3, 1e-6]) * max(weight.sum(), 1.0) + 1e-9
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = weight * p * (1 - p)
        step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def words_of(text: str) -> list[str]:
    return text.lower().split()


def features(texts: list[str], model: Model, known: dict[str, float], telling: tuple[float, ...]) -> np.ndarray:
    """A row for each text: the root of its telling words' log-likelihood ratio by word, for each limit.

    0 where no word is telling or there are no words; known: ratios of words seen so far."""
    split = [words_of(t) for t in texts]
    new = list({w for words in split for w in words if w not in known})
    if len(known) + len(new) > KEPT:
        known.clear()
        new = list({w for words in split for w in words})
    if new:
        known.update(zip(new, model.words(new).tolist()))
    out = np.zeros((len(texts), len(telling)))
    for row, words in enumerate(split):
        ratios = np.fromiter(map(known.__getitem__, words), float, len(words))
        if len(ratios) and ratios.max() >= min(telling):
            out[row] = [np.sqrt(ratios[ratios >= limit].sum() / len(ratios)) for limit in telling]
    return out


def gram_counts(sample: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) of rows (text, toxic): words by the texts that have them, then their grams."""
    words = sample.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"), "toxic").where("word != ''")
    words = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    marked = words.select(F.concat(F.lit(OPEN), "word", F.lit(CLOSE)).alias("w"), "t", "o")
    each = marked.select("w", "t", "o", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("i"))
    gram = F.expr(f"substring(w, greatest(1, i - {ORDER - 1}), least(i, {ORDER}))")
    return each.groupBy(gram.alias("gram")).agg(F.sum("t").alias("toxic"), F.sum("o").alias("ordinary"))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", most: int = MOST) -> Model:
    """A model from labelled documents (labels: key, toxic 0 or 1) whose key `allowed` lets in.

    Bounded: at most `most` documents of each class, those whose keys hash lowest. Four fifths of them are
    counted, the others place the curve, weighted so that the classes keep their shares among all labelled
    rows. A document with several labels has the highest one; null labels and null keys are left out."""
    known = labels.select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic")).where(F.col("key").isNotNull() & F.col("toxic").isin(0, 1)).where(allowed)
    known = written(known.groupBy("key").agg(F.max("toxic").alias("toxic")), "labels")
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64(F.lit(42), "key")
    sample = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(rank, "key").limit(most)
        sample = part if sample is None else sample.union(part)
    texts = docs.select(F.col(key).alias("key"), fold(text).alias("text"))
    sample = written(texts.join(F.broadcast(sample), "key").select("key", "text", "toxic", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(5)).alias("part")), "sample")
    grams = gram_counts(sample.where("part != 0")).toArrow()
    model = fitted(grams["gram"], grams["toxic"].to_numpy().astype(float), grams["ordinary"].to_numpy().astype(float))
    del grams
    shown = sample.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> dict:
        texts, known = batch.column(0).to_pylist(), {}
        parts = [features(texts[i : i + SLICE], shown.value, known, TELLING) for i in range(0, len(texts), SLICE)]
        return {"feature": np.concatenate(parts).tolist(), "toxic": batch.column(1)}

    rest = map_batches(sample.where("part = 0").select("text", "toxic"), each, "feature array<double>, toxic int").toPandas()
    if rest["toxic"].nunique() == 2:
        share = rest["toxic"].map({k: n / max(1, (rest["toxic"] == k).sum()) for k, n in total.items()}).to_numpy(float)
        x, y, best = np.stack(rest["feature"].to_numpy()), rest["toxic"].to_numpy(float), np.inf
        for i, limit in enumerate(TELLING):
            curve = logistic(x[:, i], y, share / share.mean())
            odds = curve[0] * x[:, i] + curve[1]
            loss = (share * np.logaddexp(0, np.where(y == 1, -odds, odds))).sum()
            if loss < best:
                best, (model.slope, model.offset), model.telling = loss, curve, limit
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, score (0 to 1), ratio (root of the log-likelihood ratio by word).

    Only the text is looked at. Null and empty texts have ratio 0; equal texts have equal scores; repeated
    rows stay; an empty table gives no rows. The model is broadcast: its size is bounded by the sample."""
    shown = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> dict:
        held, texts = shown.value, batch.column(1).to_pylist()
        known = kept("toxicity", held, dict)
        ratio = np.concatenate([features(texts[i : i + SLICE], held, known, (held.telling,))[:, 0] for i in range(0, len(texts), SLICE)])
        return {"key": batch.column(0), "score": held.probability(ratio), "ratio": ratio}

    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), fold(text).alias("text"))
    return map_batches(plain, each, f"key {kind}, score double, ratio double").withColumnRenamed("key", key)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, held_out, score, predicted, ratio of every document; learns from rows that are not held out."""
    model = fit(docs, labels, fifth("key") != 0, key, text, most)
    out = scored(docs, model, key, text)
    return out.select(key, (fifth(key) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ratio")


def score_of(spark, model: Model):
    """A function of a text column that gives the score, for filters that keep all columns."""
    shown = spark.sparkContext.broadcast(model)

    def scores(texts: pd.Series) -> pd.Series:
        held, column = shown.value, texts.fillna("").tolist()
        known = kept("toxicity", held, dict)
        parts = [features(column[i : i + SLICE], held, known, (held.telling,))[:, 0] for i in range(0, len(column), SLICE)]
        return pd.Series(held.probability(np.concatenate([*parts, np.zeros(0)])))

    return F.pandas_udf(scores, "double")
