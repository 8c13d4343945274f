"""SimHash near-duplicates through covering locality-sensitive hashing.

A radius r needs 2^(r+1) - 1 tables: bit i gets a non-zero vector of r + 1 bits, table v keeps the bits whose
vector has an odd product with v. Any r differing bits leave some v orthogonal to all their vectors, so that
table sees two equal keys: every pair within the radius meets, whatever the data."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import fold, map_batches, written
from tidegate.plans.components import components

SEED = 42
#: Members up to which a bucket's pairs are compared directly; larger buckets go by shared midpoints.
SMALL = 32
#: Shingles whose bits are counted at a time, so that a very long text needs no more memory.
BLOCK = 1 << 16


def fingerprint(words: list[bytes], size: int) -> bytes:
    """Eight bytes, most significant first: a bit is 1 if it is set in more than half of the shingle hashes."""
    if not words:
        return bytes(8)
    joined, ends = b" ".join(words), [n - 1 for n in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[size - 1 :])) if len(words) >= size else [(0, len(joined))]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(spans), BLOCK):
        block = b"".join([digest(joined[a:b], SEED) for a, b in spans[at : at + BLOCK]])
        ones += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(spans)).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp): the fingerprint as a signed long. Null and empty texts have fingerprint 0."""

    def each(batch: pa.RecordBatch) -> dict:
        prints = [fingerprint(t.encode().lower().split(), size) for t in batch.column(1).to_pylist()]
        return {"key": batch.column(0), "fp": np.frombuffer(b"".join(prints), ">i8").astype(np.int64)}

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("key"), fold(text)), each, f"key {kind}, fp bigint")


def masks(radius: int) -> list[int]:
    """The covering tables' masks over 64 bits."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, no repeats) that join all that lie within the radius.

    A bucket of few members is compared pair by pair. In a large one every member names the points within half
    the radius; those that name the same point lie within the radius of each other and are linked to its
    smallest. That is linear in the members and loses no component."""
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks(radius))]))
    rows = prints.select("fp", tables.alias("s")).select("fp", "s.t", "s.k")
    sizes = written(rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = rows.join(sizes, ["t", "k"])
    near = F.filter("fps", lambda y: (y < F.col("a")) & (F.bit_count(y.bitwiseXOR(F.col("a"))) <= radius))
    few = (
        members.where(F.col("n") <= small)
        .groupBy("t", "k")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.explode("fps").alias("a"), "fps")
        .select("a", F.explode(near).alias("b"))
    )
    low, high = radius // 2, radius - radius // 2
    dense = members.where(F.col("n") > small).select("fp").distinct()
    points = dense.select("fp", F.lit(-1).alias("last"), F.lit(0).alias("d"), F.col("fp").alias("z"))
    balls = points
    for step in range(high):
        bits = F.explode(F.sequence(F.col("last") + 1, F.lit(63)))
        points = points.where("last < 63").select("fp", bits.alias("last"), (F.lit(step) + 1).alias("d"), "z")
        points = points.select("fp", "last", "d", F.expr("z ^ shiftleft(1L, last)").alias("z"))
        balls = balls.union(points)
    stars = balls.groupBy("z").agg(F.min(F.when(F.col("d") <= low, F.col("fp"))).alias("b"), F.collect_set("fp").alias("fps"))
    many = stars.where("b is not null and size(fps) > 1").select(F.explode("fps").alias("a"), "b").where("a != b")
    return few.union(many).distinct()


def groups(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(key, fp, component) for fingerprints (key, fp): the smallest key reachable over links within the radius.

    Equal fingerprints are one node, however many rows have them. Null keys take part and keep their row; a
    component of null keys alone has a null component."""
    nodes = written(prints.groupBy("fp").agg(F.min("key").alias("low")), "prints")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    lows = placed.groupBy("root").agg(F.min("low").alias("component"))
    return prints.join(placed.join(lows, "root").select("fp", "component"), "fp").select("key", "fp", "component")


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component (smallest key reachable).

    Documents link when their fingerprints differ in at most `radius` bits. Repeated rows stay repeated;
    texts of no words have fingerprint zero and link like any other; an empty table gives no rows."""
    prints = written(fingerprints(docs, key, text, size), "fingerprints")
    placed = groups(prints, radius)
    return placed.select(F.col("key").alias(key), hexed().alias("fingerprint"), "component")
