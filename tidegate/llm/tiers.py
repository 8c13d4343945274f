"""Hierarchical packing of documents into windows of several lengths."""

from __future__ import annotations

import heapq
import zlib
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
from tidegate.llm.packing import GROUP, Rooms
from tidegate.llm.tokenids import token_groups

TIERS = (2048, 1024, 512, 256)


def route(n: int, tiers: tuple[int, ...]) -> int:
    """The shortest window that holds n tokens."""
    return min(t for t in tiers if t >= n)


def pack_tiers(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(window, pieces) with pieces (document, start, length); every window is full.

    A document longer than the longest tier gives whole windows of it and a rest. Documents and rests go to
    the shortest tier that holds them. From the longest tier down, each window takes its tier's longest piece,
    then the longest ones of the shorter tiers that fit its gap; a gap that nothing fits is filled by the
    start of the shortest remaining piece, whose rest stays for the windows that follow. What is left at the
    end closes in windows of the largest power of two that it fills."""
    longest, windows, rooms = tiers[0], [], Rooms(tiers[0])
    left = 0
    for doc, n in enumerate(lengths):
        whole = n // longest * longest
        windows += [(longest, [(doc, start, longest)]) for start in range(0, whole, longest)]
        if n > whole:
            rooms.put(n - whole, (doc, whole))
            left += n - whole

    def fill(window: int) -> None:
        pieces, gap = [], window
        while gap:
            size = rooms.at_most(gap)
            if size:
                doc, start = rooms.take(size)
                pieces.append((doc, start, size))
                gap -= size
            else:
                size = rooms.at_least(gap)
                doc, start = rooms.take(size)
                pieces.append((doc, start, gap))
                rooms.put(size - gap, (doc, start + gap))
                gap = 0
        windows.append((window, pieces))

    for window in tiers:
        while left >= window and (size := rooms.at_most(window)) and route(size, tiers) == window:
            fill(window)
            left -= window
    while left:
        window = min(longest, 1 << (left.bit_length() - 1))
        fill(window)
        left -= window
    return windows


def step_groups(windows: list[int], tokens: int) -> list[int]:
    """A step for each window, so that all steps hold nearly equally many tokens: the longest windows first,
    each to the step that has least."""
    steps = max(1, -(-sum(windows) // tokens))
    loads, step = [(0, i) for i in range(steps)], [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i]):
        load, at = heapq.heappop(loads)
        step[i] = at
        heapq.heappush(loads, (load + windows[i], at))
    return step


SCHEMA = "key {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint, step_id bigint{ids}"


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int | None = 1, step_tokens: int = 1 << 14, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_id.

    with_ids adds the piece's ids as little-endian unsigned 32-bit bytes. Tiers are powers of two, longest
    first. A task packs what it reads in groups of about `group` tokens: nothing is shuffled or gathered, and
    a rerun of the same files gives the same windows. Each id of a text and end_id after it (None: none) lie
    in exactly one piece; null texts count as empty; null keys and repeated rows stay; an empty table gives
    no rows. sequence_id and step_id are unique over all tasks; steps hold about step_tokens tokens."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers must be falling powers of two")
    sent = docs.sparkSession.sparkContext.broadcast(content_of(vocabulary))
    schema = SCHEMA.format(key=docs.schema[key].dataType.simpleString(), ids=", ids binary" if with_ids else "")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = step = TaskContext.get().partitionId() << 40
        for keys, ids, counts in token_groups(batches, sent.value, end_id, group):
            ids = ids.astype("<u4", copy=False)
            offsets = np.cumsum(counts) - counts
            windows = pack_tiers(counts.tolist(), tiers)
            steps = step_groups([w for w, _ in windows], step_tokens)
            rows = [(doc, start, n, number, window) for number, (window, pieces) in enumerate(windows) for doc, start, n in pieces]
            doc, start, n, number, window = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            at = offsets[doc] + start
            stops = np.cumsum(n)
            begins = np.searchsorted(number, np.arange(len(windows)))
            spans = [ids[a : a + b].tobytes() for a, b in zip(at.tolist(), n.tolist())]
            columns = {
                "key": [keys[d] for d in doc.tolist()],
                "start": start,
                "length": n,
                "ids_crc32": [zlib.crc32(s) for s in spans],
                "doc_tokens": counts[doc],
                "sequence_id": sequence + number,
                "offset": stops - n - (stops - n)[begins][number] if len(n) else n,
                "window": window,
                "step_id": step + np.array(steps, np.int64)[number] if len(n) else n,
                "ids": spans,
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)
            sequence += len(windows)
            step += max(steps, default=-1) + 1

    packed = bounded(docs).select(F.col(key).alias("key"), fold(text).alias("text")).mapInArrow(run, schema)
    return packed.withColumnRenamed("key", key)
