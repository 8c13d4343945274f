"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import fold, kept, map_batches
from tidegate.llm.pretokens import END, Table, Vocabulary, looked_up, pieces, split


@lru_cache(maxsize=1)
def byte_marks() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it prints,
    else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs, with a number for every symbol, from a vocabulary file's content."""

    def __init__(self, content: str):
        model = json.loads(content)["model"]
        if model.get("type") != "BPE":
            raise ValueError(f"not a byte-pair vocabulary: {model.get('type')}")
        number = model["vocab"]
        self.byte = [number[m] for m in byte_marks()]
        self.rank = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[number[left], number[right]] = (rank, number[left + right])

    def count(self, text: str) -> int:
        """Symbols left of one pre-token: its bytes minus the merges, lowest rank first and leftmost among equals."""
        symbols = [self.byte[b] for b in text.encode()]
        left = n = len(symbols)
        if n < 2:
            return n
        rank = self.rank
        heap = [(*found, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := rank.get(pair))]
        heap = [(r, i, symbols[i], symbols[i + 1], made) for r, made, i in heap]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one side was merged meanwhile
            symbols[i], symbols[j] = made, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rank.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := rank.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return left


class Counter:
    """Counts tokens of texts; one per Python worker and vocabulary."""

    def __init__(self, content: str):
        self.vocabulary, self.merges, self.table = Vocabulary(content), Merges(content), Table()

    def words(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.merges.count, texts), np.int32, len(texts))

    def counts(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        for owners, parts in pieces(texts, self.vocabulary.cut):
            points, starts, ends, part = split(parts, self.vocabulary)
            owner = np.asarray(owners)[part]
            special = points[starts] > END
            total += np.bincount(owner[special], minlength=len(texts))
            starts, ends, owner = starts[~special], ends[~special], owner[~special]
            found = looked_up(self.table, points, starts, ends, self.words)
            total += np.bincount(owner, weights=found, minlength=len(texts)).astype(np.int64)
        return total


def content_of(path: str) -> str:
    """A vocabulary file, read on the driver; its content (1 to 3 MB) goes with the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit.

    vocabulary: path of a byte-level BPE file of the tokenizers library. Null and empty texts have 0 bytes and
    0 tokens; repeated rows stay repeated; special strings inside a text count as one token each; whole texts
    are counted, whatever their length. An empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(content_of(vocabulary))

    def each(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        counter = kept("token counts", sent.value, lambda: Counter(sent.value))
        return {"key": batch.column(0), "n_bytes": batch.column(2), "n_tokens": counter.counts(texts)}

    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), fold(text).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = map_batches(plain, each, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
