"""Merkle manifest of a document table: bitmap ranks place the leaves, slot arrays reduce the levels.

A leaf's coordinate is its rank among the ids of its tree. Ids are set as bits of 64-bit words, only words that
hold an id are kept, and partial words of all tasks are merged by OR while they are shuffled. A directory holds
the number of leaves before each block of 65,536 ids and before each word, so that a rank is two lookups and a
popcount; leaves themselves are never sorted. Nodes are then dealt to arrays of `arity ** levels` slots by
(tree, coordinate), and each array is reduced by that many levels at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import written
from tidegate.llm.keyed import hot_limit, matched
from tidegate.plans.ordered import chunked, row_numbers, running

#: Levels that one slot array reduces: 4,096 slots for runs of two.
LEVELS, ARITY = 12, 2
_NULL_WORD = -(1 << 58)  # below the word of any id
_HOT_WORD = 100_000  # words with more rows than this (and a share of all) are ordered in chunks


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(documents: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered, row) of each document; `tampered` is the leaf after one was added to n_chars
    of a document whose id's CRC-32 seven divides, else null. `row` tells equal rows apart."""
    kinds = dict(documents.dtypes)
    doc_id, chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")

    def leaf(n_chars: Column) -> Column:
        return F.sha2(F.concat(_field(doc_id), _field(F.col("source")), _field(F.col("lang")), _field(n_chars), _field(F.col("text"))), 256)

    missing = [c for c in ("doc_id", "source", "lang", "n_chars", "text") if c not in kinds]
    if missing:
        raise ValueError(f"documents lack {missing}")
    chosen = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & chars.isNotNull()
    return documents.select(
        F.when(F.col("lang").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("lang"))).alias("tree"),
        doc_id.alias("doc_id"),
        leaf(chars).alias("leaf"),
        F.when(chosen, leaf(chars.cast("decimal(20,0)") + 1)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )


def _word() -> Column:
    return F.coalesce(F.shiftright("doc_id", 6), F.lit(_NULL_WORD))


def _bit() -> Column:
    return F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")


def bitmaps(nodes: DataFrame) -> DataFrame:
    """Words of (tree, doc_id): bits, number of rows, leaves of the tree before the word, and size of the tree."""
    set_bit = F.expr("shiftleft(1L, bit)")
    words = written(
        nodes.select("tree", _word().alias("word"), _bit().alias("bit"))
        .groupBy("tree", "word")
        .agg(F.bit_or(set_bit).alias("bits"), F.count("*").alias("n_rows"))
        .withColumn("block", F.shiftright("word", 10)),
        "words",
    )
    blocks = written(words.groupBy("tree", "block").agg(F.sum("n_rows").alias("_rows")), "blocks")
    trees = written(blocks.groupBy("tree").agg(F.sum("_rows").alias("size"), F.count("*").alias("_blocks")), "trees")
    cut = chunked(blocks, [F.col("block")])
    starts = running(cut, [F.col("block")], {"_start": ("sum", F.col("_rows"))}, ["tree"], inclusive=False)
    starts = matched(written(starts.select("tree", "block", "_start"), "starts"), trees, ["tree"], "_blocks").drop("_blocks")
    inside = Window.partitionBy("tree", "block").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("_inside", F.coalesce(F.sum("n_rows").over(inside), F.lit(0))).join(starts, ["tree", "block"])
    before = F.col("_inside") + F.coalesce("_start", F.lit(0))
    return written(placed.select("tree", "word", "bits", "n_rows", before.alias("before"), "size"), "directory")


def ranked(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """`nodes` with their place in their tree (from 0) and the tree's size; equal ids follow by leaf.

    Ids that occur once cost a popcount. In words with repeated ids rows are numbered: by a window where the word
    has few rows, else by `plans.ordered`, which cuts the order into chunks."""
    rows = nodes.withColumns({"word": _word(), "bit": _bit()})
    found = matched(rows, words, ["tree", "word"], "n_rows", least=_HOT_WORD)
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    single = F.expr("bit_count(bits) = n_rows")
    kept = [*nodes.columns, "place", "size"]
    once = found.where(single).withColumn("place", F.col("before") + below).select(*kept)
    limit = hot_limit(words, "n_rows", _HOT_WORD)
    repeated = words.where(~single).select("tree", "word", "n_rows")
    most = repeated.agg(F.max("n_rows")).first()[0]
    if most is None:
        return once
    order = ["bit", F.col("doc_id").asc_nulls_first(), "leaf", "row"]
    number = F.row_number().over(Window.partitionBy("tree", "word").orderBy(*order))
    few = found.where(~single & (F.col("n_rows") <= limit)).withColumn("place", F.col("before") + number - 1).select(*kept)
    out = once.unionByName(few)
    if most <= limit:
        return out
    hot = repeated.where(F.col("n_rows") > limit).select("tree", "word")  # at most keyed.MOST_HOT
    ids = written(hot.withColumn("_hot_no", F.row_number().over(Window.orderBy("tree", "word"))), "hot")
    many = found.where(~single & (F.col("n_rows") > limit)).join(F.broadcast(ids), ["tree", "word"])
    start = F.conv(F.substring("leaf", 1, 12), 16, 10).cast("long")
    keys = [F.col("_hot_no"), F.col("bit"), start, F.col("row")]
    cut = written(row_numbers(written(many, "repeated"), keys, name="_nth"), "numbered")
    first = F.broadcast(cut.groupBy("_hot_no").agg(F.min("_nth").alias("_first")))
    numbered = cut.join(first, "_hot_no").withColumn("place", F.col("before") + F.col("_nth") - F.col("_first"))
    return out.unionByName(numbered.select(*kept))


def _hash(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def _height(size: int, arity: int) -> int:
    height = 0
    while size > 1:
        size, height = -(-size // arity), height + 1
    return height


def _filled(slots: int, places: np.ndarray, digests: pd.Series) -> list[str]:
    """Digests by slot; coordinates of one array have no gaps."""
    out: list = [None] * slots
    for place, digest in zip(places % slots, digests, strict=True):
        out[place] = digest
    return out[: len(places)]


def _reduced(nodes: list[str], steps: int, arity: int) -> list[list[str]]:
    """Levels of an array from its slots up."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([_hash("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return levels


def _siblings(levels: list[list[str]], slot: int, arity: int) -> list[tuple[int, list[str]]]:
    """(own position, the others) of a slot's run on each level below the top."""
    out = []
    for nodes in levels[:-1]:
        first = slot - slot % arity
        run = nodes[first : first + arity]
        out.append((slot - first, run[: slot - first] + run[slot - first + 1 :]))
        slot //= arity
    return out


def _text(path: list[tuple[int, list[str]]]) -> str:
    return "/".join(f"{at}:{','.join(others)}" for at, others in path)


def _path(text: str) -> list[tuple[int, list[str]]]:
    return [(int(level.partition(":")[0]), [x for x in level.partition(":")[2].split(",") if x]) for level in text.split("/") if level]


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf gives with the siblings of its path."""
    for at, others in path:
        leaf = _hash("".join(others[:at]) + leaf + "".join(others[at:]))
    return leaf


def reduced(nodes: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> list[DataFrame]:
    """Rounds of nodes (tree, place, size, digest): those given, then the tops of their slot arrays, and so on
    until each tree has one node. Every array is one group of at most `arity ** levels` short rows."""
    slots = arity**levels

    def tops(part: pd.DataFrame) -> pd.DataFrame:
        size, group = int(part["size"].iloc[0]), int(part["place"].iloc[0]) // slots
        steps = min(levels, _height(size, arity))
        top = _reduced(_filled(slots, part["place"].to_numpy(), part["digest"]), steps, arity)[-1]
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "place": [group], "size": [-(-size // slots)], "digest": top})

    rounds = [nodes.select("tree", "place", "size", "digest")]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        dealt = rounds[-1].withColumn("_group", F.floor(F.col("place") / F.lit(slots)))
        rounds.append(written(dealt.groupBy("tree", "_group").applyInPandas(tops, "tree string, place long, size long, digest string"), "nodes"))
    return rounds


def _described(rounds: list[DataFrame], upper: DataFrame, each: Callable, columns: str, levels: int, arity: int) -> DataFrame:
    """Carry `upper` (tree, path, subroot, root), one row a tree, down the rounds; `each` gives the rows of the first."""
    slots = arity**levels

    def opened(give: Callable, schema: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def down(part: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
            if not len(part):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            steps = min(levels, _height(int(part["size"].iloc[0]), arity))
            array = _reduced(_filled(slots, part["place"].to_numpy(), part["digest"]), steps, arity)
            rest, subroot, root = (over[c].iloc[0] for c in ("path", "subroot", "root"))
            return give(part, [_siblings(array, int(p) % slots, arity) for p in part["place"]], _path(rest), subroot, root)

        return down

    above = upper.select("tree", F.lit(0).cast("long").alias("_group"), "path", "subroot", "root")
    below = [(nodes, _inner, _CARRIED) for nodes in rounds[1:-1][::-1]] + [(rounds[0], each, columns)]
    for nodes, give, schema in below:
        dealt = nodes.withColumn("_group", F.floor(F.col("place") / F.lit(slots))).groupBy("tree", "_group")
        above = dealt.cogroup(above.groupBy("tree", "_group")).applyInPandas(opened(give, schema), schema)
        above = above if give is each else written(above, "paths")
    return above


def _inner(part: pd.DataFrame, paths: list, rest: list, subroot: str, root: str) -> pd.DataFrame:
    """Paths of the tops of one round, which are the arrays of the round before."""
    return pd.DataFrame({"tree": part["tree"], "_group": part["place"], "path": [_text(p + rest) for p in paths], "subroot": subroot, "root": root})


_CARRIED = "tree string, _group long, path string, subroot string, root string"
_ROW = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(part: pd.DataFrame, paths: list, rest: list, subroot: str, root: str) -> pd.DataFrame:
    """Result rows of one slot array of leaves."""
    above = "".join("".join(others) for _, others in rest)
    proofs = [_hash("".join("".join(others) for _, others in path) + above) for path in paths]
    starts = [t if isinstance(t, str) else d for t, d in zip(part["tampered"], part["digest"], strict=True)]
    folded = [fold(s, path + rest) for s, path in zip(starts, paths, strict=True)]
    return pd.DataFrame(
        {"doc_id": part["doc_id"].astype("Int64"), "leaf": part["digest"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded,
         "verified": [f == root for f in folded]}
    )


def manifest(documents: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """One row per document: its leaf, the root of its language's tree, the root of all, the digest of its proof,
    and the root recomputed from its (for some documents tampered) leaf.

    A null in any column counts as such in the leaf; null ids come first in their language and null languages are a
    tree of their own, before all others; rows of one id follow by leaf, equal rows in any order. One document is
    its own root. Other columns are not looked at. No documents give no rows."""
    nodes = written(leaves(documents), "leaves")
    placed = written(ranked(nodes, bitmaps(nodes)).withColumnRenamed("leaf", "digest"), "places")
    trees = reduced(placed, levels, arity)
    roots = trees[-1].select(F.col("tree").alias("_of"), "digest")
    first = F.conv(F.hex(F.rpad(F.substring(F.col("_of").cast("binary"), 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("long")
    order = written(row_numbers(roots, [first], ["_of"], "_nth"), "roots")
    size = order.count()
    top = order.select(
        F.lit("").alias("tree"), (F.col("_nth") - 1).cast("long").alias("place"), F.lit(size).cast("long").alias("size"), "digest", F.col("_of")
    )
    over = reduced(top, levels, arity)
    if not size:
        return documents.sparkSession.createDataFrame([], _ROW)
    root = over[-1].select(F.lit("").alias("tree"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    upper = written(_described([top, *over[1:]], root, _of_tree, _CARRIED.replace(" _group long,", ""), levels, arity), "upper")
    return _described([placed, *trees[1:]], upper, _proved, _ROW, levels, arity)


def _of_tree(part: pd.DataFrame, paths: list, rest: list, subroot: str, root: str) -> pd.DataFrame:
    """Paths of the subroots of one slot array."""
    return pd.DataFrame({"tree": part["_of"], "path": [_text(p + rest) for p in paths], "subroot": part["digest"], "root": root})
