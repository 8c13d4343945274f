"""Near copies by word shingles: candidates by prefixes and SimHash, exact similarity, one document of each group.

Sets of few shingles are ordered by how often a shingle occurs, rare ones first. Two sets that share enough
of their union share one of the first n - ceil(similarity n) + 1, so no pair of short documents is missed. A
pair of long ones just above the similarity differs in more bits of a whole document's fingerprint than
covering tables can span. So each also gets fingerprints of parts: shingles are dealt to parts by their hash,
alike in all documents, and a part of a near copy often holds the very same few shingles. Equal prefix
shingles, equal fingerprints of a part, and whole fingerprints within the radius, make candidates; only pairs
whose shingle sets reach the similarity link."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import fold, map_batches, written
from tidegate.llm.simhash import BLOCK, SEED, masks, signed
from tidegate.plans.components import components

#: Shingles of a part are between this many and twice as many on average; parts of a document, at most.
PART, PARTS = 3, 16
#: Shingles up to which a set is short: its candidates are exact. Pairs with a larger set go by fingerprints.
SHORT = 64
#: Members up to which a bucket's pairs are listed, and members of a block of a larger one.
SMALL, MEMBERS = 32, 256
#: Places of the counts that order shingles; those that share one count together, which any order allows.
SLOTS = 1 << 16


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of a text's shingles, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (np.append(0, stops[:-1]))[: max(1, len(words) - size + 1)].tolist()
    ends = (stops[size - 1 :] - 1).tolist() if len(words) >= size else [len(joined)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The signed fingerprint of hashes: a bit is 1 if it is set in more than half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def levels(n: int, similarity: float) -> list[int]:
    """Exponents of the numbers of parts for a set of n shingles: its own, and that of a similar larger set."""
    return sorted({max(0, math.floor(math.log2(max(1.0, x / PART)))) for x in (n, n / similarity)})


def part_prints(kinds: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(part, fingerprint) of the non-empty parts of a set of distinct hashes; a part's number has its level."""
    out = []
    for level in levels(len(kinds), similarity) if len(kinds) else []:
        place = (kinds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) & np.uint64((1 << level) - 1)
        for part in range(min(PARTS, 1 << level)):
            held = kinds[place == part]
            if len(held):
                out.append((level * PARTS + part, majority(held)))
    return out


SKETCH = "row bigint, key {key}, h1 bigint, h2 bigint, w1 bigint, w2 bigint, n int, fp bigint, parts array<struct<part: int, print: bigint>>, shingles binary"


def sketched(docs: DataFrame, key: str, text: str, size: int, similarity: float) -> DataFrame:
    """One row per document with what the steps need: a row number, hashes of the text and of its words,
    the fingerprints of whole and parts (of sets that a long one may be like), and the distinct shingles as
    32-bit hashes with their number."""

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("w1", "w2", "n", "fp", "parts", "shingles")}
        for text in batch.column(4).to_pylist():
            words = text.encode().lower().split()
            joined = b" ".join(words)
            for i in (1, 2):
                out[f"w{i}"].append(int.from_bytes(xxhash.xxh64_digest(joined, i), "big", signed=True))
            hashes = shingle_hashes(words, size)
            kinds = np.unique(hashes)
            held = np.unique((kinds >> np.uint64(32)).astype("<u4"))
            long = len(held) >= math.floor(similarity * SHORT)
            out["n"].append(len(held))
            out["fp"].append(majority(hashes) if long else 0)
            out["parts"].append([{"part": p, "print": f} for p, f in part_prints(kinds, similarity)] if long else [])
            out["shingles"].append(held.tobytes())
        return {"row": batch.column(3), "key": batch.column(0), "h1": batch.column(1), "h2": batch.column(2), **out}

    marks = [F.xxhash64(F.lit(i), fold(text)).alias(f"h{i}") for i in (1, 2)]
    plain = docs.select(F.col(key).alias("key"), *marks, F.monotonically_increasing_id().alias("row"), fold(text).alias("text"))
    return written(map_batches(plain, each, SKETCH.format(key=docs.schema[key].dataType.simpleString())), "sketch")


def similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, sa, sb: shingles) whose sets' intersection is at least that share of their union."""

    def each(batch: pa.RecordBatch) -> dict:
        keep = []
        for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(one, "<u4"), np.frombuffer(other, "<u4")
            both = 0 if min(len(x), len(y)) < similarity * max(len(x), len(y)) else len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both))
        return {"a": batch.column(0), "b": batch.column(1), "keep": keep}

    return map_batches(pairs, each, "a bigint, b bigint, keep boolean").where("keep").select("a", "b")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each slot."""

    def each(batch: pa.RecordBatch) -> dict:
        held = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
        counts = np.bincount(held % SLOTS, minlength=SLOTS)
        slots = np.flatnonzero(counts)
        return {"slot": slots, "n": counts[slots]}

    out = np.zeros(SLOTS, np.int64)
    for r in map_batches(sets.select("shingles"), each, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(row, n, k): the rarest shingles of each set, as many as make every similar pair share one."""
    counts = slot_counts(sets)

    def each(batch: pa.RecordBatch) -> dict:
        taken, sizes = [], []
        for held in batch.column(2).to_pylist():
            x = np.frombuffer(held, "<u4")
            take = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1
            taken.append(x[np.lexsort((x, counts[x % SLOTS]))[:take]])
            sizes.append(len(taken[-1]))
        place = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        return {"row": batch.column(0).take(place), "n": batch.column(1).take(place), "k": np.concatenate(taken).astype(np.int64)}

    return map_batches(sets.select("row", "n", "shingles"), each, "row bigint, n int, k bigint")


def buckets(seen: DataFrame, nodes: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(kind, k, row, n, first, members) for the given nodes (row): the buckets of more than one, with their least row.

    Kinds from 0 are equal parts; -1 is an equal shingle of the prefixes of short sets; kinds below are the
    covering tables of whole fingerprints."""
    short = prefixes(seen.where(F.col("n").between(1, SHORT)), similarity).join(nodes, "row").select(F.lit(-1).alias("kind"), "k", "row", "n")
    long = seen.where(F.col("n") >= math.floor(similarity * SHORT)).select("row", "n", "fp", "parts").join(nodes, "row")
    tables = [F.struct(F.lit(-2 - t).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks(radius))]
    parts = F.transform("parts", lambda p: F.struct(p["part"].alias("kind"), p["print"].alias("k")))
    each = long.select("row", "n", F.explode(F.concat(parts, F.array(*tables))).alias("p")).select("p.kind", "p.k", "row", "n").union(short)
    bucket = Window.partitionBy("kind", "k")
    placed = each.withColumns({"first": F.min("row").over(bucket), "members": F.count("*").over(bucket)})
    return written(placed.where("members > 1"), "buckets")


def across(rows: np.ndarray, roots: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Similar pairs that join what isn't joined yet, between two blocks, or within one if there is one only.

    Intersections are counted over the places of each shingle, for all members at once."""
    sizes = np.array([len(x) for x in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    parent = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, one = [], blocks.min() == blocks.max()
    for i in np.flatnonzero(blocks == blocks.min()):
        lows, highs = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], "right")
        lengths = highs - lows
        at = np.repeat(lows - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(owners[at], minlength=len(sets))
        fits = (both >= similarity * (sizes + sizes[i] - both)) & (roots != roots[i])
        fits &= np.arange(len(sets)) > i if one else blocks != blocks[i]
        for j in np.flatnonzero(fits):
            a, b = find(int(roots[i])), find(int(roots[j]))
            if a != b:
                parent[a] = b
                out.append((int(rows[i]), int(rows[j])))
    return out


def unjoined(shared: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): similar pairs of members of a bucket that have different roots (node, root) so far.

    Buckets whose members all have one root are done. The others' pairs across roots are all compared:
    listed in small buckets, block against block in large ones; of buckets with the same members one is."""
    placed = shared.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "row")).alias(f"x{i}") for i in (1, 2)]
    open_ = placed.groupBy("kind", "k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("members").alias("size"), F.min("row").alias("least"), *marks)
    open_ = open_.where("low != high").dropDuplicates(["size", "least", "x1", "x2"]).select("kind", "k")
    members = written(placed.join(open_, ["kind", "k"]), "open")
    listed = members.where(F.col("members") <= SMALL).groupBy("kind", "k", "first").agg(F.collect_list(F.struct("row", "root", "n")).alias("held"))
    listed = listed.select("first", "held", F.explode("held").alias("x"))
    near = lambda y: (y["row"] < F.col("x.row")) & (y["row"] != F.col("first")) & (y["root"] != F.col("x.root")) & (F.least(y["n"], F.col("x.n")) >= similarity * F.greatest(y["n"], F.col("x.n")) - 1e-9)
    pairs = listed.select(F.col("x.row").alias("a"), F.explode(F.filter("held", near)).alias("y")).select("a", F.col("y.row").alias("b")).distinct()
    few = similar(pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb"), similarity)
    blocks = F.ceil(F.col("members") / MEMBERS).cast("int")
    many = members.where(F.col("members") > SMALL).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "row"), blocks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = many.select("kind", "k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row", "root", "block").join(sets, "row")

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        frame = frame.sort_values("row", ignore_index=True)
        if frame["root"].nunique() > 1 and (frame["i"].iloc[0] == frame["j"].iloc[0] or frame["block"].nunique() > 1):
            held = [np.frombuffer(x, "<u4") for x in frame["shingles"]]
            found = across(frame["row"].to_numpy(), frame["root"].to_numpy(), frame["block"].to_numpy(), held, similarity)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return few.union(many.groupBy("kind", "k", "i", "j").applyInPandas(each, "a bigint, b bigint"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest key stays, as it is.

    Two documents link when their sets of word shingles (A-Z in lower case) share at least `similarity` of
    their union; equal word sequences always do. Groups are what links join. Texts of fewer words than a
    shingle are one shingle; texts of no words, null included, are copies of each other. Of rows that repeat
    key and text one stays. Null keys come first. An empty table gives no rows."""
    seen = sketched(docs, key, text, size, similarity)
    nodes = written(seen.groupBy("w1", "w2").agg(F.min("row").alias("node")), "nodes")
    shared = buckets(seen, nodes.select(F.col("node").alias("row")), similarity, radius)
    pairs = written(shared.where("row != first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct(), "candidates")
    sets = seen.select("row", "shingles")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    joined = written(similar(both, similarity), "joined")
    more = written(unjoined(shared, written(components(joined), "roots"), sets, similarity), "more")
    roots = components(joined.union(more))
    groups = nodes.join(roots, "node", "left").select("w1", "w2", F.coalesce("root", "node").alias("root"))
    one = F.min(F.struct("key", "row", "h1", "h2")).alias("one")
    kept = seen.select("key", "row", "h1", "h2", "w1", "w2").join(groups, ["w1", "w2"]).groupBy("root").agg(one)
    times = seen.groupBy("key", "h1", "h2").agg(F.count("*").alias("times")).where("times > 1")
    kept = written(kept.select(F.col("one.key").alias("_key"), F.col("one.h1").alias("_k1"), F.col("one.h2").alias("_k2")), "kept")
    repeated = written(times.select(F.col("key").alias("_key"), F.col("h1").alias("_k1"), F.col("h2").alias("_k2")), "repeated")
    marked = docs.withColumns({f"_h{i}": F.xxhash64(F.lit(i), fold(text)) for i in (1, 2)})
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    left = marked.join(kept, same, "left_semi")
    if not repeated.isEmpty():
        twice = left.join(repeated, same, "left_semi").dropDuplicates([key, "_h1", "_h2"])
        left = left.join(repeated, same, "left_anti").unionByName(twice)
    return left.drop("_h1", "_h2")
