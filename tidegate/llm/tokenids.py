"""Token ids of whole texts, as the tokenizers library gives them: each distinct pre-token is encoded once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidegate.llm.common import kept
from tidegate.llm.pretokens import END, Table, Vocabulary, looked_up, pieces, ragged, split

#: Pre-tokens that the library encodes in one call.
CALL = 1000
#: Texts encoded at a time.
SLICE = 256


class Encoder:
    """Encodes texts; one per Python worker and vocabulary."""

    def __init__(self, content: str):
        self.vocabulary, self.table = Vocabulary(content), Table()
        self.fresh()

    def fresh(self) -> None:
        """The pool of ids by number; special strings come first."""
        special = list(self.vocabulary.special.values())
        self.pool, self.filled = np.zeros(1 << 20, np.uint32), len(special)
        self.pool[: len(special)] = special
        self.at, self.size, self.known = np.zeros(1 << 19, np.int64), np.zeros(1 << 19, np.int64), len(special)
        self.at[: len(special)], self.size[: len(special)] = np.arange(len(special)), 1

    def words(self, texts: list[str]) -> np.ndarray:
        first = self.known
        for i in range(0, len(texts), CALL):
            block = texts[i : i + CALL]
            coded = self.vocabulary.library.encode(block, is_pretokenized=True, add_special_tokens=False)
            ids, sizes = np.array(coded.ids, np.uint32), np.bincount(np.array(coded.word_ids, np.int64), minlength=len(block))
            while self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while self.known + len(block) > len(self.at):
                self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.at[self.known : self.known + len(block)] = self.filled + np.cumsum(sizes) - sizes
            self.size[self.known : self.known + len(block)] = sizes
            self.filled += len(ids)
            self.known += len(block)
        return np.arange(first, self.known, dtype=np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one after another, and how many each text has."""
        flat, total = [], np.zeros(len(texts), np.int64)
        for owners, parts in pieces(texts, self.vocabulary.cut):
            points, starts, ends, part = split(parts, self.vocabulary)
            number = np.zeros(len(starts), np.int32)
            special = points[starts] > END
            number[special] = points[starts[special]] - (END + 1)
            number[~special] = looked_up(self.table, points, starts[~special], ends[~special], self.words, self.fresh)
            sizes = self.size[number]
            flat.append(self.pool[ragged(self.at[number], sizes)])
            total += np.bincount(np.asarray(owners)[part], weights=sizes, minlength=len(texts)).astype(np.int64)
        return np.concatenate([*flat, np.zeros(0, np.uint32)]), total


def token_groups(batches: Iterator[pa.RecordBatch], content: str, end_id: int | None, most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, ids, counts) of rows (key, text): groups of about `most` tokens, each text whole, end_id after it."""
    coder, keys, flat, counts, size = kept("token ids", content, lambda: Encoder(content)), [], [], [], 0
    for batch in batches:
        texts, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for i in range(0, len(texts), SLICE):
            ids, n = coder.ids(texts[i : i + SLICE])
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1
            keys += names[i : i + SLICE]
            flat.append(ids)
            counts.append(n)
            size += len(ids)
            if size >= most:
                yield keys, np.concatenate(flat), np.concatenate(counts)
                keys, flat, counts, size = [], [], [], 0
    if keys:
        yield keys, np.concatenate(flat), np.concatenate(counts)
