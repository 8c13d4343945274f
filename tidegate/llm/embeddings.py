"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import map_batches, written
from tidegate.plans.components import components

#: Vectors that the rotations are learned from, at most.
SAMPLE = 10_000
#: Share of the pairs at the threshold that the tables may miss, as measured on pairs made from the sample.
MISSED = 0.02
#: Pairs that agreement is measured on.
PAIRS = 4_000
#: Vectors of a bucket that are compared as one block.
BLOCK = 256


@dataclass
class Codes:
    """Rotations to balanced binary codes, and how the codes are cut into tables."""

    mean: np.ndarray
    rotations: list[np.ndarray]
    width: int
    tables: int

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit code of each unit vector for each rotation."""
        weights = np.uint64(1) << np.arange(self.rotations[0].shape[1], dtype=np.uint64)
        return np.stack([((unit - self.mean) @ r > 0) @ weights for r in self.rotations], axis=1)

    def keys(self, codes: np.ndarray, table: int) -> np.ndarray:
        """The substring of the codes that a table is looked up by."""
        each = self.rotations[0].shape[1] // self.width
        return (codes[:, table // each] >> np.uint64(table % each * self.width)) & np.uint64((1 << self.width) - 1)


def quantised(unit: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """A rotation of the principal axes that brings the sample near the corners of a cube: codes and rotation
    are fitted to each other in turn."""
    if len(unit) > 1:
        _, axes = np.linalg.eigh(np.cov(unit.T).reshape(unit.shape[1], -1))
        axes = axes[:, ::-1][:, :bits]
    else:
        axes = np.eye(unit.shape[1])[:, :bits]
    spin, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    plane = (unit - unit.mean(axis=0)) @ axes if len(unit) else np.zeros((0, bits))
    for _ in range(rounds if len(unit) else 0):
        left, _, right = np.linalg.svd(np.sign(plane @ spin).T @ plane)
        spin = (left @ right).T
    return axes @ spin


def at_threshold(sample: np.ndarray, threshold: float, rng: np.random.Generator, number: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose cosine is the threshold: sample vectors, each turned towards another one."""
    if len(sample) < 2 or sample.shape[1] < 2:
        return sample[:0], sample[:0]
    first, other = sample[rng.integers(0, len(sample), number)], sample[rng.integers(0, len(sample), number)]
    aside = other - sample.mean(axis=0) + 1e-6 * rng.standard_normal(other.shape)
    aside -= (aside * first).sum(axis=1, keepdims=True) * first
    aside /= np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    return first, threshold * first + math.sqrt(max(0.0, 1 - threshold * threshold)) * aside


def learned(sample: np.ndarray, size: int, threshold: float, seed: int = 42) -> Codes:
    """Codes for `size` vectors, cut into tables that pairs at the threshold meet in.

    Codes are signs of centred vectors, so how often a pair agrees depends on the data and not on its cosine
    alone: vectors with a common offset are much wider apart around their mean. The width of a substring is the
    one with the least work, from the measured agreement of pairs at the threshold and of any two vectors; then
    rotations are added until at most MISSED of the pairs at the threshold have met in no table."""
    dims, rng = sample.shape[1], np.random.default_rng(seed)
    bits = min(64, dims)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dims)
    widest = max(1, min(bits, max(6, round(math.log2(max(size, 2))) - 4)))
    first, second = at_threshold(sample, threshold, rng)
    if not len(first):
        return Codes(mean, [quantised(sample, bits, rng)], widest, 1)
    rotations = [quantised(sample, bits, rng)]

    def agreeing(rotation: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        same = ((a - mean) @ rotation > 0) == ((b - mean) @ rotation > 0)
        each = bits // width
        return same[:, : each * width].reshape(len(same), each, width).all(axis=2)

    any_two = sample[rng.integers(0, len(sample), PAIRS)]

    def work(width: int) -> float:
        met = agreeing(rotations[0], first, second, width).mean()
        tables = math.log(MISSED) / math.log(max(1e-9, 1 - met)) if 0 < met < 1 else 1.0 if met else math.inf
        crowd = size * max(agreeing(rotations[0], any_two, first, width).mean(), 0.5**width)
        return max(1.0, tables) * (1 + crowd / BLOCK)

    width = min(range(widest, min(widest, 4) - 1, -1), key=work)
    missed, tables = np.ones(len(first), bool), 0
    while True:
        met = agreeing(rotations[-1], first, second, width)
        for table in range(met.shape[1]):
            missed &= ~met[:, table]
            tables += 1
            if missed.mean() <= MISSED:
                return Codes(mean, rotations, width, tables)
        rotations.append(quantised(sample, bits, rng))


def joined(hits: np.ndarray) -> np.ndarray:
    """The first member of each row's component of a symmetric relation."""
    label = np.arange(len(hits))
    while True:
        low = np.minimum(label, np.where(hits, label[None, :], len(hits)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def unit_rows(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    rows = flat.reshape(len(column), -1)
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def links(vectors: DataFrame, codes: Codes, threshold: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(node, n) and (a, b) of distinct vectors (node, copies, vector): how many rows of other vectors each one
    links with, and edges that join what links join.

    Buckets are cut into blocks, and every two blocks of a bucket meet in one group, so no task holds a large
    bucket. A pair counts in the first table that shows it. Pairs stay in the task: out come sums and, for
    each group, a star for each of its components."""
    spark = vectors.sparkSession
    shown = spark.sparkContext.broadcast(codes)

    def coded(batch: pa.RecordBatch) -> dict:
        code = shown.value(unit_rows(batch.column(2)))
        keys = np.stack([shown.value.keys(code, t) for t in range(shown.value.tables)], axis=1)
        return {"node": batch.column(0), "copies": batch.column(1), "vector": batch.column(2), "codes": code.view(np.int64).tolist(), "ks": keys.astype(np.int64).tolist()}

    rows = written(map_batches(vectors.select("node", "copies", "vector"), coded, f"node bigint, copies bigint, vector {dict(vectors.dtypes)['vector']}, codes array<bigint>, ks array<bigint>"), "codes")
    large = rows.select(F.posexplode("ks").alias("t", "k")).groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = written(large.select("t", "k", F.ceil(F.col("n") / block).alias("parts")), "buckets")
    dealt = rows.select("node", "copies", "vector", "codes", F.posexplode("ks").alias("t", "k")).join(large, ["t", "k"], "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(1), "node"), parts).cast("int")
    others = F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", others)
    dealt = dealt.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "codes", "vector")
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")

    def compare(group: pa.RecordBatch) -> Iterator[tuple]:
        if group.num_rows < 2:
            return
        table, cross = group["t"][0].as_py(), group["i"][0].as_py() != group["j"][0].as_py()
        unit = unit_rows(group["vector"])
        hits = unit @ unit.T >= threshold
        hits[np.arange(len(hits)), np.arange(len(hits))] = False
        if cross:
            own = group["own"].to_numpy()
            hits &= own[:, None] != own[None, :]
        if not hits.any():
            return
        a, b = np.nonzero(hits)
        code = np.array(group["codes"].to_pylist(), np.int64).view(np.uint64)
        for earlier in range(table):
            key = shown.value.keys(code, earlier)
            late = key[a] != key[b]
            hits[a[~late], b[~late]] = False
            a, b = a[late], b[late]
        if not len(a):
            return
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        totals = hits @ copies
        first = joined(hits | hits.T)
        for row in np.nonzero(totals)[0]:
            yield int(node[row]), int(node[first[row]]), int(totals[row])

    schema = pa.schema([("node", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            found = []
            if batch is None:
                if held is not None:
                    found = list(compare(held))
            else:
                rows = batch if held is None else pa.concat_batches([held, batch])
                marks = np.stack([rows[c].to_numpy() for c in ("t", "k", "i", "j")], axis=1)
                starts = np.append(np.nonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1)))[0], len(marks))
                for s, e in zip(starts[:-2], starts[1:-1]):
                    found += compare(rows.slice(s, e - s))
                held = rows.slice(starts[-2])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    found = written(dealt.mapInArrow(run, "node bigint, b bigint, n bigint"), "links")
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    return sums, found.select(F.col("node").alias("a"), "b").where("a != b").distinct()


def _and_end(batches: Iterator) -> Iterator:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def near_groups(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: key (an integer), n_links, component (smallest key reachable over links), kept.

    Two vectors link when their cosine in double precision is at least the threshold; other columns, such as
    labels, are not looked at. Equal vectors are one node with its number of copies. Vectors that are null,
    empty, zero or hold null or non-finite components, and those whose length isn't the most common one, link
    with nothing; so do rows of a null key, which have a null component and are not kept. Repeated rows stay
    and count as vectors. An empty table gives no rows. Nothing below the threshold links; the tables are laid
    out to miss few pairs at the threshold, and all rows are in them."""
    exact = "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(exact).alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("key").isNotNull() & F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    marks = [F.when(F.col("sound"), F.xxhash64(F.lit(i), "vector")).alias(f"h{i}") for i in (1, 2)]
    rows = rows.withColumn("sound", sound).select("key", "vector", "sound", *marks)
    nodes = rows.where("sound").groupBy("h1", "h2").agg(F.min("key").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = written(nodes, "nodes")
    common = nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"), F.col("key").isNotNull().alias("kept"))
    same = nodes.where(F.size("vector") == common["d"])
    some = same.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toArrow()
    codes = learned(unit_rows(some["vector"].combine_chunks()), common["n"], threshold)
    sums, edges = links(same, codes, threshold, block)
    roots = components(edges)
    known = nodes.select("h1", "h2", "node", "copies").join(sums, "node", "left").join(roots, "node", "left")
    known = known.select(
        "h1",
        "h2",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component"),
    )
    out = rows.select("key", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
