"""Best-fit-decreasing packing of token ids into windows, searched by a segment tree over free room."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegate.llm.bpe import content_of
from tidegate.llm.common import bounded, fold
from tidegate.llm.tokenids import token_groups

#: Tokens that a task holds and packs at a time.
GROUP = 1 << 21


class Rooms:
    """Stacks of things by a size from 0 to `most`; finds the nearest size that has one, in logarithmic time."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: dict[int, list] = {}

    def __len__(self) -> int:
        return self.count[1]

    def _change(self, size: int, by: int) -> None:
        node = size + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, size: int, thing) -> None:
        self.stacks.setdefault(size, []).append(thing)
        self._change(size, 1)

    def take(self, size: int):
        self._change(size, -1)
        return self.stacks[size].pop()

    def at_least(self, size: int) -> int | None:
        """The smallest size from `size` on that has something."""
        node = size + self.leaves
        if node >= 2 * self.leaves:
            return None
        if self.count[node]:
            return size
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def at_most(self, size: int) -> int | None:
        """The largest size up to `size` that has something."""
        node = min(size, self.leaves - 1) + self.leaves
        if self.count[node]:
            return node - self.leaves
        while node > 1:
            if node & 1 and self.count[node - 1]:
                node -= 1
                while node < self.leaves:
                    node = 2 * node + 1 if self.count[2 * node + 1] else 2 * node
                return node - self.leaves
            node >>= 1
        return None


def best_fit(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length). Documents longer than a window give whole windows and a
    rest; the rests go, longest first, where the least room that holds them is left. Empty ones take no room."""
    windows, rests, rooms = [], [], Rooms(window)
    for doc, n in enumerate(lengths):
        whole = n // window * window
        windows += [[(doc, start, window)] for start in range(0, whole, window)]
        if n > whole:
            rests.append((n - whole, doc, whole))
    for n, doc, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        room = rooms.at_least(n)
        if room is None:
            room, place = window, len(windows)
            windows.append([])
        else:
            place = rooms.take(room)
        windows[place].append((doc, start, n))
        if room > n:
            rooms.put(room - n, place)
    return windows


SCHEMA = "sequence_id bigint, n_tokens bigint, ids binary, segment_ends array<int>, positions binary, documents array<{key}>, starts array<bigint>"


def pack_ids(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = 2048, end_id: int | None = 50256, pad_id: int = 50256, group: int = GROUP) -> DataFrame:
    """Rows of a packed id matrix, one per window.

    ids: `window` little-endian unsigned 32-bit ids, padded with pad_id; segment_ends: cumulative lengths of
    the pieces, so the last one is n_tokens; positions: little-endian unsigned 32-bit place of each id in its
    piece, from 0 at every piece, 0 in the padding; documents, starts: each piece's key and the ids of its
    document before it. Each id of each text, and end_id after the text (None: none), lies in exactly one
    piece. A task packs what it reads in groups of `group` tokens, so nothing is shuffled or gathered.
    Null texts count as empty: with end_id they are one id, without they take no piece. Null keys and repeated
    rows stay. An empty table gives no rows. The pieces can be put together again with `unpacked`."""
    sent = docs.sparkSession.sparkContext.broadcast(content_of(vocabulary))
    schema = SCHEMA.format(key=docs.schema[key].dataType.simpleString())
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for keys, ids, counts in token_groups(batches, sent.value, end_id, group):
            offsets = np.cumsum(counts) - counts
            windows = best_fit(counts.tolist(), window)
            for at in range(0, len(windows), 512):
                block = windows[at : at + 512]
                matrix = np.full((len(block), window), pad_id, "<u4")
                places = np.zeros((len(block), window), "<u4")
                ends = []
                for row, pieces in enumerate(block):
                    fill, stops = 0, []
                    for doc, start, n in pieces:
                        matrix[row, fill : fill + n] = ids[offsets[doc] + start : offsets[doc] + start + n]
                        places[row, fill : fill + n] = np.arange(n)
                        fill += n
                        stops.append(fill)
                    ends.append(stops)
                columns = {
                    "sequence_id": np.arange(first + at, first + at + len(block)),
                    "n_tokens": [stops[-1] for stops in ends],
                    "ids": [row.tobytes() for row in matrix],
                    "segment_ends": ends,
                    "positions": [row.tobytes() for row in places],
                    "documents": [[keys[p[0]] for p in pieces] for pieces in block],
                    "starts": [[p[1] for p in pieces] for pieces in block],
                }
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)
            first += len(windows)

    return bounded(docs).select(F.col(key).alias("key"), fold(text).alias("text")).mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrix rows as a Parquet table; the committed files are whole even if executors are lost."""
    packed.write.parquet(path)


def unpacked(packed: DataFrame) -> DataFrame:
    """(document, start, ids) of every piece: the ids as an array of longs. Inverse of the packing."""
    at = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.element_at("segment_ends", F.greatest("i", F.lit(1))))
    piece = packed.select("ids", "segment_ends", "starts", F.posexplode("documents").alias("i", "document"))
    piece = piece.select("document", F.element_at("starts", F.col("i") + 1).alias("start"), F.expr("substring(ids, 4 * {0} + 1, 4 * (element_at(segment_ends, i + 1) - {0}))".format("if(i = 0, 0, element_at(segment_ends, greatest(i, 1)))")).alias("raw"))
    one = "cast(conv(concat({}), 16, 10) as bigint)".format(", ".join(f"hex(substring(raw, 4 * j + {i}, 1))" for i in (4, 3, 2, 1)))
    return piece.select("document", "start", F.expr(f"transform(sequence(0, length(raw) div 4 - 1), j -> {one})").alias("ids"))
