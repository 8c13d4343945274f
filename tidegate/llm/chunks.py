"""Document fingerprints by content-defined chunks, and how much of a document another one contains."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegate.llm.common import bounded, fold, map_batches, shared_partitions

#: Bytes of a chunk: at least, usually, at most. Shorter only at the end of a text.
LEAST, USUAL, MOST = 16, 40, 255
#: Leading zero bits of the rolling hash at a cut before and after the usual length.
STRICT, LOOSE = 7, 4
#: Texts handled at a time.
SLICE = 128
#: Random numbers of the bytes; the byte 0, which also parts texts in a buffer, counts as nothing.
GEAR = np.random.default_rng(2016).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
GEAR[0] = 0


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: each byte's number shifted left by its distance, over 32 bytes."""
    h = GEAR[data]
    for n in (1, 2, 4, 8, 16):
        h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    return h


def cuts(size: int, strict: list[int], loose: list[int]) -> Iterator[tuple[int, int]]:
    """Chunks of a text, from the places where the hash has STRICT and LOOSE leading zeros (sorted)."""
    start = i = j = 0
    while size - start > LEAST:
        end = min(start + MOST, size)
        i = bisect_left(strict, start + LEAST - 1, i)
        if i < len(strict) and strict[i] < start + USUAL:
            end = min(end, strict[i] + 1)
        else:
            j = bisect_left(loose, start + USUAL, j)
            if j < len(loose) and loose[j] < end:
                end = loose[j] + 1
        yield start, end
        start = end
    if start < size:
        yield start, size


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text its distinct chunks: a 32-bit digest with the chunk's length."""
    gap = bytes(32)
    buffer = gap + gap.join(texts)
    h = rolling(np.frombuffer(buffer, np.uint8))
    loose = np.nonzero(h >> np.uint32(32 - LOOSE) == 0)[0]
    strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0]
    out, at, digest = [], 32, xxhash.xxh32_intdigest
    for text in texts:
        a, b = np.searchsorted(strict, (at, at + len(text)))
        c, d = np.searchsorted(loose, (at, at + len(text)))
        spans = cuts(len(text), (strict[a:b] - at).tolist(), (loose[c:d] - at).tolist())
        out.append({digest(text[s:e]): e - s for s, e in spans})
        at += len(text) + 32
    return out


def contained(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's chunk lengths whose chunks b has too; nothing is wholly contained in nothing only."""
    if not a:
        return float(not b)
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


def written_out(chunks: dict[int, int]) -> str:
    """Ten hex digits for each chunk, sorted: eight of the digest, two of the length."""
    return "".join(sorted([f"{d:08x}{n:02x}" for d, n in chunks.items()]))


def containment(a: str, b: str) -> Column:
    """`contained` for two columns of written fingerprints."""
    parts = "transform(sequence(1, greatest(length({0}) div 10, 1)), i -> substring({0}, 10 * i - 9, 10))"
    weight = "aggregate({0}, 0L, (s, p) -> s + cast(conv(substring(p, 9, 2), 16, 10) as bigint))"
    own, other = parts.format(a), parts.format(b)
    share = f"{weight.format(f'array_intersect({own}, {other})')} / {weight.format(own)}"
    return F.expr(f"case when {a} = '' then if({b} = '', 1D, 0D) else {share} end")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of whole texts; null counts as empty, whose fingerprint is empty."""

    def each(batch: pa.RecordBatch) -> dict:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        return {"key": batch.column(0), "fingerprint": [written_out(c) for i in range(0, len(texts), SLICE) for c in chunk_sets(texts[i : i + SLICE])]}

    kind = docs.schema[key].dataType.simpleString()
    out = map_batches(docs.select(F.col(key).alias("key"), fold(text)), each, f"key {kind}, fingerprint string")
    return out.withColumnRenamed("key", key)


def ranges(docs: DataFrame, parts: int) -> tuple[Column, int]:
    """A column with each row's place among about equal ranges of (key, hash), and their number; null keys first.

    Bounds are approximate quantiles of the key, at most one for each range; a key heavier than a range, and the
    null keys, are cut by quantiles of the hash. A row's place is the number of bounds up to it."""
    key = F.col("key").cast("long")
    at = [i / parts for i in range(1, parts)] or [0.5]
    found = docs.select(F.percentile_approx(key, at, 10 * parts), F.count("*"), F.count_if(key.isNull())).first()
    if parts < 2 or not found[1]:
        return F.lit(0), 1
    cuts = found[0] or []
    ranges_of = {k: cuts.count(k) for k in set(cuts) if cuts.count(k) > 1}
    empty = round(parts * found[2] / found[1])
    if empty > 1:
        ranges_of[None] = empty
    bounds = {(k, -(1 << 63)) for k in cuts} | ({(min(cuts), -(1 << 63))} if found[2] and cuts else set())
    fine = [i / (4 * parts) for i in range(1, 4 * parts)]
    if ranges_of:
        keys = [k for k in ranges_of if k is not None]
        heavy = key.isin(keys) if keys else F.lit(False)
        heavy = F.coalesce(heavy, F.lit(False)) | (key.isNull() if None in ranges_of else F.lit(False))
        hashes = docs.where(heavy).groupBy(key.alias("k")).agg(F.percentile_approx("hash", fine, 40 * parts).alias("h")).collect()
        for row in hashes:
            n = ranges_of[row["k"]]
            bounds |= {(row["k"], row["h"][len(fine) * i // n]) for i in range(1, n)}
            # What follows a heavy key begins a range of its own.
            bounds |= {(row["k"], -(1 << 63))} | ({(row["k"] + 1, -(1 << 63))} if row["k"] is not None and row["k"] < (1 << 63) - 1 else set())
    bounds = sorted(bounds, key=lambda b: (b[0] is not None, b[0] or 0, b[1]))
    limits = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(h).cast("long").alias("hash")) for k, h in bounds])
    own = F.struct(key.alias("key"), F.col("hash").alias("hash"))
    place = F.size(F.filter(limits, lambda limit: limit <= own))
    return place, len(bounds) + 1


SCHEMA = "key {key}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its code points replaced by the first as many of the next document,
    by ascending key (an integer); after the last comes the first. near_edited and near_next are the shares of
    the document that the edited text and the next document contain.

    Texts are dealt once, to ranges of the key, and sorted there; each range also gets the first document of
    the next one, so neighbours meet without a window over all rows. Null keys come first; rows with the same
    key go by a hash of the text and then the text; null texts count as empty; a single document is its own
    next; an empty table gives no rows."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    parts = parts or shared_partitions(spark)
    plain = docs.select(F.col(key).alias("key"), fold(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    place, number = ranges(plain, parts)
    rows = plain.select(place.alias("place"), F.lit(0).alias("extra"), "key", "hash", "text")
    lowest = rows.select("place", "key", "hash").groupBy("place").agg(F.min(F.struct("key", "hash")).alias("low"))
    lows = sorted((r["place"], r["low"]["key"], r["low"]["hash"]) for r in lowest.collect())
    wanted = spark.createDataFrame(lows, f"own int, low {kind}, low_hash long")
    follows = {p: lows[i - 1][0] for i, (p, _, _) in enumerate(lows)}
    same = (F.col("own") == F.col("place")) & F.col("key").eqNullSafe(F.col("low")) & (F.col("hash") == F.col("low_hash"))
    first = rows.join(F.broadcast(wanted), same)
    first = first.groupBy("place").agg(F.min(F.struct("key", "hash", "text")).alias("f"))
    before = F.create_map(*[F.lit(x) for pair in follows.items() for x in pair]) if follows else F.create_map(F.lit(0), F.lit(0))
    first = first.select(before[F.col("place")].alias("place"), F.lit(1).alias("extra"), "f.key", "f.hash", "f.text")
    dealt = rows.union(first).repartitionByRange(number, "place").sortWithinPartitions("place", "extra", "key", "hash", "text")
    target = to_arrow_schema(StructType.fromDDL(SCHEMA.format(key=kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the last row, whose next one is still to come, with its chunks
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(3).to_pylist()
                sets = chunk_sets([t.encode() for t in texts])
                seen = held + list(zip(*(part.column(i).to_pylist() for i in range(3)), texts, sets))
                pairs = [(a, b) for a, b in zip(seen, seen[1:]) if a[0] == b[0] and not a[1]]
                held = seen[-1:]
                if not pairs:
                    continue
                edited = [(a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2]).encode() for a, b in pairs]
                edited_sets = chunk_sets(edited)
                columns = {
                    "key": [a[2] for a, _ in pairs],
                    "n_chars": [len(a[3]) for a, _ in pairs],
                    "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                    "fingerprint": [written_out(a[4]) for a, _ in pairs],
                    "edited_fingerprint": [written_out(s) for s in edited_sets],
                    "near_edited": [contained(a[4], s) for (a, _), s in zip(pairs, edited_sets)],
                    "near_next": [contained(a[4], b[4]) for a, b in pairs],
                }
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    out = bounded(dealt).select("place", "extra", "key", "text").mapInArrow(run, SCHEMA.format(key=kind))
    return out.withColumnRenamed("key", key)
