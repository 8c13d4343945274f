"""Prefix trie of conversations: ternary search trees over turn ids per range shard, merged at their boundaries.

Turns become dictionary ids, conversations sequences of ids, and equal sequences one row with their members.
Sequences are dealt to shards by ranges of their order. A shard inserts its sequences into a ternary search tree,
medians first, and walks it iteratively. Only prefixes of its first and last sequence can go on in another shard:
these boundary nodes are merged, neighbours first, in groups of shards until one is left; all others are final.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegate.llm.common import bounded, written
from tidegate.llm.keyed import matched

#: Turns of distinct sequences that a shard holds, about, and shards whose boundaries are merged at once.
PER_SHARD, GROUP = 200_000, 64
_ENDS = 12  # ids of members are joined in pieces of 4,096 consecutive numbers
_NOBODY = hashlib.sha256(b"").hexdigest()
_SEQUENCE = "skey string, ids array<long>, chars array<int>, n long, low long, ends string"
#: What a node has gathered; of a boundary node only from children that are final. `up` is the parent's prefix key.
_NODE = (
    "shard int, depth int, key string, up string, low long, n long, chars int, kids long, leaves long, saved long, ends string, "
    "parent_low long, first boolean, last boolean, settled boolean"
)
_FIELDS = [c.split()[0] for c in _NODE.split(", ")]


def _turns(conversations: DataFrame) -> DataFrame:
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    role = text("role")
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text("text")), 256)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
        F.char_length(text("text")).cast("int").alias("chars"),
    )


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, chars): dictionary ids of each conversation's turns in order, and code points of their texts.

    Turns without a number come first, turns of one number follow by the digest of role and text."""
    turns = written(_turns(conversations), "turns")
    entries = turns.groupBy("key").agg(F.count("*").alias("_n"))
    dictionary = written(entries.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = matched(turns, dictionary, ["key"], "_n")
    row = F.struct("turn", "key", "id", "chars")
    ordered = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: t["id"]).alias("ids"), F.transform("t", lambda t: t["chars"]).alias("chars"))


def shared_openings(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with the opening of conversation c - c % `every`: its first h turns, if it exists, then
    c's own after its first h; h is the CRC-32 of c's digits modulo `most`."""
    own = sequences.withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    own = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every)
    bases = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.slice("ids", 1, most).alias("_ids"), F.slice("chars", 1, most).alias("_chars")
    )
    both = own.join(bases, "_base", "left")

    def rebuilt(name: str) -> Column:
        opening = F.coalesce(F.col(f"_{name}"), F.array().cast(dict(sequences.dtypes)[name]))
        mine = F.slice(F.col(name), F.col("_h") + 1, F.greatest(F.size(name), F.lit(1)))
        return F.concat(F.slice(opening, F.lit(1), F.col("_h")), mine)

    return both.select("conv_id", rebuilt("ids").alias("ids"), rebuilt("chars").alias("chars"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """One row per distinct sequence, with its number of members, the smallest, and the SHA-256 of their ids.

    Ids of members are first joined in pieces of 4,096 consecutive numbers, so a sequence of any number of members
    is hashed piece by piece in order, in bounded memory."""
    keyed = sequences.withColumn("skey", F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256))
    members = keyed.groupBy("skey", F.shiftright("conv_id", _ENDS).alias("piece")).agg(
        F.first("ids").alias("ids"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("low"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("joined"),
    )
    target = to_arrow_schema(StructType.fromDDL(_SEQUENCE))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, hashed = None, None
        for batch in batches:
            done = []
            for skey, ids, chars, n, low, joined in zip(*(batch[c].to_pylist() for c in ("skey", "ids", "chars", "n", "low", "joined")), strict=True):
                if row is not None and row[0] == skey:
                    hashed.update(b"," + joined.encode())
                    row[3] += n
                    continue
                if row is not None:
                    done.append((*row, hashed.hexdigest()))
                row, hashed = [skey, ids, chars, n, low], hashlib.sha256(joined.encode())
            if done:
                yield _batch(done, target)
        if row is not None:
            yield _batch([(*row, hashed.hexdigest())], target)

    return bounded(members.repartition("skey").sortWithinPartitions("skey", "piece")).mapInArrow(close, _SEQUENCE)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


class TernaryTree:
    """Ternary search tree over sequences of ids in parallel lists; entry 0 is the textless root.

    `lower` and `higher` lead to other ids at the same place of a sequence, `equal` to the next place."""

    def __init__(self) -> None:
        self.id, self.lower, self.equal, self.higher, self.up, self.depth, self.chars = ([0] for _ in range(7))
        self.n: list[int] = [0]
        self.low: list[int | None] = [None]
        self.ends: list[str] = [_NOBODY]

    def _new(self, value: int, chars: int, up: int) -> int:
        for column, cell in zip((self.id, self.lower, self.equal, self.higher, self.up, self.depth, self.chars), (value, 0, 0, 0, up, self.depth[up] + 1, chars), strict=True):
            column.append(cell)
        self.n.append(0)
        self.low.append(None)
        self.ends.append(_NOBODY)
        return len(self.id) - 1

    def _child(self, up: int, value: int, chars: int) -> int:
        at, links, owner = self.equal[up], self.equal, up
        while at:
            if value == self.id[at]:
                return at
            links, owner = (self.lower if value < self.id[at] else self.higher), at
            at = links[owner]
        links[owner] = self._new(value, chars, up)
        return links[owner]

    def insert(self, ids: list[int], chars: list[int], n: int, low: int, ends: str) -> list[int]:
        """Add a sequence with n members; the nodes of its path."""
        path = [0]
        for value, size in zip(ids, chars, strict=True):
            path.append(self._child(path[-1], value, size))
        for at in path:
            self.n[at] += n
            if self.low[at] is None or low < self.low[at]:
                self.low[at] = low
        self.ends[path[-1]] = ends
        return path

    def walk(self) -> list[int]:
        """All nodes by an explicit stack, parents before their children, ids ascending."""
        order, stack = [], [(0, False)]
        while stack:
            at, opened = stack.pop()
            if not opened:
                if self.higher[at]:
                    stack.append((self.higher[at], False))
                stack.append((at, True))
                if self.lower[at]:
                    stack.append((self.lower[at], False))
            else:
                order.append(at)
                if self.equal[at]:
                    stack.append((self.equal[at], False))
        return order


def medians(number: int) -> Iterator[int]:
    """Positions 0 to number - 1: the middle, then the middles of both halves, and so on."""
    spans = [(0, number)]
    for low, high in spans:
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += [(low, middle), (middle + 1, high)]


def _prefix_keys(ids: list[int]) -> list[str]:
    keys = [_NOBODY]
    for value in ids:
        keys.append(hashlib.sha256(f"{keys[-1]},{value}".encode()).hexdigest())
    return keys


def shard_nodes(shard: int, rows: list[tuple]) -> list[tuple]:
    """Nodes (_NODE) of the sequences (ids, chars, n, low, ends) of one shard, which are in order."""
    tree = TernaryTree()
    for place in medians(len(rows)):
        path = tree.insert(*rows[place])
        if place == 0:
            first = path
        if place == len(rows) - 1:
            last = path
    keys = dict(zip(first, _prefix_keys(rows[0][0]), strict=True)) | dict(zip(last, _prefix_keys(rows[-1][0]), strict=True))
    heads, tails = set(first), set(last)
    size = len(tree.id)
    kids, leaves, saved = [0] * size, [0] * size, [0] * size
    order = tree.walk()
    for at in reversed(order):
        if at in keys:
            continue
        leaves[at] = leaves[at] or 1
        saved[at] += (tree.n[at] - 1) * tree.chars[at]
        up = tree.up[at]
        kids[up] += 1
        leaves[up] += leaves[at]
        saved[up] += saved[at]
    out = []
    for at in order:
        up, key = tree.up[at], keys.get(at)
        out.append((
            shard, tree.depth[at], key, keys.get(up) if at else None, tree.low[at], tree.n[at], tree.chars[at], kids[at], leaves[at], saved[at], tree.ends[at],
            None if up in keys else tree.low[up], at in heads, at in tails, key is None,
        ))
    return out


def _sharded(sequences: DataFrame, per_shard: int) -> DataFrame:
    turns = sequences.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(math.ceil(turns / per_shard), 1)
    dealt = sequences.repartitionByRange(shards, "ids").sortWithinPartitions("ids").withColumn("shard", F.spark_partition_id())
    target = to_arrow_schema(StructType.fromDDL(_NODE))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard = [], 0
        for batch in batches:
            rows += zip(*(batch[c].to_pylist() for c in ("ids", "chars", "n", "low", "ends")), strict=True)
            shard = batch["shard"][0].as_py() if batch.num_rows else shard
        nodes = shard_nodes(shard, rows) if rows else []
        for start in range(0, len(nodes), 10_000):
            yield _batch(nodes[start : start + 10_000], target)

    return written(bounded(dealt.select("ids", "chars", "n", "low", "ends", "shard")).mapInArrow(build, _NODE), "shards")


def merge_boundaries(rows: list[dict], whole: bool) -> list[dict]:
    """Boundary nodes of neighbouring shards as those of one; nodes that can't go on beyond it are settled.

    `whole` says that there are no other shards."""
    low_shard, high_shard = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[str, dict] = {}
    for row in rows:
        ends = {"first": row["first"] and row["shard"] == low_shard and not whole, "last": row["last"] and row["shard"] == high_shard and not whole}
        node = nodes.get(row["key"])
        if node is None:
            nodes[row["key"]] = {**row, **ends, "shard": low_shard, "settled": False}
            continue
        for name in ("n", "kids", "leaves", "saved"):
            node[name] += row[name]
        node["low"] = min(node["low"], row["low"])
        node["ends"] = row["ends"] if node["ends"] == _NOBODY else node["ends"]
        node["first"], node["last"] = node["first"] or ends["first"], node["last"] or ends["last"]
    for node in sorted(nodes.values(), key=lambda r: -r["depth"]):
        if node["first"] or node["last"]:
            continue
        node["settled"] = True
        node["leaves"] = node["leaves"] or 1
        node["saved"] += (node["n"] - 1) * node["chars"]
        if node["depth"]:
            up = nodes[node["up"]]
            up["kids"] += 1
            up["leaves"] += node["leaves"]
            up["saved"] += node["saved"]
    return list(nodes.values())


def _merger(group: int, whole: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, "up": r["up"] if r["depth"] else None} for r in part[_FIELDS].to_dict("records")]
        merged = merge_boundaries(rows, whole)
        return pd.DataFrame([{**m, "shard": m["shard"] // group, "parent_low": None} for m in merged], columns=_FIELDS)

    return merge


def prefix_nodes(sequences: DataFrame, per_shard: int = PER_SHARD, group: int = GROUP) -> DataFrame:
    """Every distinct prefix of the sequences (conv_id, ids, chars), the root of depth 0 among them: the smallest
    member conv_id, depth, the parent's smallest member, members, children, childless nodes below (itself counted
    where it has no child), tokens saved by sharing it and all below, and the SHA-256 of the members that end here.

    Memory: a shard holds about `per_shard` turns, and a conversation's ids lie in one row. No sequences, no rows."""
    shards = _sharded(written(distinct_sequences(sequences), "sequences"), per_shard)
    boundary, settled = shards.where("not settled"), []
    while True:
        spread = boundary.agg(F.min("shard"), F.max("shard")).first()
        if spread[0] is None:
            break
        whole = spread[1] // group == spread[0] // group

        grouped = boundary.withColumn("_group", F.floor(F.col("shard") / F.lit(group)))
        merged = written(grouped.groupBy("_group").applyInPandas(_merger(group, whole), _NODE), "boundaries")
        settled.append(merged.where("settled"))
        boundary = merged.where("not settled")
        if whole:
            break
    final = shards.where("settled")
    for part in settled:
        final = final.unionByName(part)
    # Parents that were boundary nodes: their smallest member was not known in the shard.
    inner = final.where("up is null and depth > 0").withColumn("parent_conv_id", F.col("parent_low"))
    root = final.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    open_ = final.where("up is not null")
    parents = None
    for part in settled:
        mine = part.select(F.col("key").alias("up"), F.col("low").alias("parent_conv_id"), F.col("kids").alias("_kids"))
        parents = mine if parents is None else parents.unionByName(mine)
    out = inner.unionByName(root)
    if parents is not None:
        out = out.unionByName(matched(open_, parents, ["up"], "_kids").drop("_kids"))
    return out.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 6, per_shard: int = PER_SHARD) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) rebuilt with shared openings.

    Null role or text is empty; a row without conv_id belongs to no conversation and is left out; equal rows are
    turns of their own. Other columns are not looked at. An empty table has no conversation, so not even a root."""
    sequences = written(turn_sequences(conversations), "sequences of turns")
    return prefix_nodes(shared_openings(sequences, every, most), per_shard)
