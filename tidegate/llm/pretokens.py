"""Splitting texts into the pre-tokens of a byte-level BPE vocabulary, many texts at a time in numpy.

The split is that of the vocabulary file's byte-level step: contractions, runs of letters, numbers or other
marks with at most one space before, and white space. Special tokens of the file cut the text first, as the
library's default does. Every pre-token gets a 64-bit key; a bounded table in each worker keeps what the
caller computed for a key, so that a word is encoded once and not at each of its occurrences."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, BREAK, UNSURE, SPECIAL = range(7)
END = 0x110000
#: Code points handled at a time; a longer text is cut where a run of white space starts, which no pre-token spans.
CHUNK = 1 << 19
#: Entries of a worker's table before it starts anew.
ENTRIES = 3 << 18
#: Fixed by the byte-level split: the contractions that are pre-tokens of their own.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point; those that this Python's tables do not assign are UNSURE."""
    kinds = np.full(END + 1 + 64, OTHER, np.uint8)
    for point in range(END):
        mark = chr(point)
        kind = unicodedata.category(mark)
        if kind[0] == "L":
            kinds[point] = LETTER
        elif kind[0] == "N":
            kinds[point] = NUMBER
        elif kind == "Cn":
            kinds[point] = UNSURE
        elif mark.isspace() and not 0x1C <= point <= 0x1F:
            kinds[point] = SPACE
    kinds[END] = BREAK
    kinds[END + 1 :] = SPECIAL
    return kinds


@lru_cache(maxsize=1)
def marks() -> np.ndarray:
    """A random odd number for every code point."""
    return np.random.default_rng(42).integers(0, 1 << 63, END + 65, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, 2 * CHUNK), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


class Vocabulary:
    """A vocabulary file's content (JSON of the tokenizers library) with its special strings."""

    def __init__(self, content: str):
        self.content = content
        added = json.loads(content).get("added_tokens", [])
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.content)
        return self._library

    def settle(self, point: int) -> int:
        """The class that the library's own split gives a code point."""
        parts = [b for _, (_, b) in self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(point)}1")]
        return LETTER if parts[0] == 2 else NUMBER if len(parts) == 2 else OTHER


def pieces(texts: list[str], special: re.Pattern | None) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts, each below CHUNK code points where white space allows, in groups of about CHUNK.

    A special string is a part of its own, given as a one-element tuple."""
    owners, parts, size = [], [], 0
    for owner, text in enumerate(texts):
        found = [text] if special is None or not special.search(text) else []
        if not found:
            at = 0
            for m in special.finditer(text):
                found += [text[at : m.start()], (m.group(),)]
                at = m.end()
            found.append(text[at:])
        for part in found:
            while isinstance(part, str) and len(part) > CHUNK:
                m = re.compile(r"(?<=[^\s\x1c-\x1f]) ").search(part, CHUNK // 2)
                if not m:
                    break
                owners.append(owner)
                parts.append(part[: m.start()])
                part = part[m.start() :]
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(owner)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def split(parts: list, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """(points, starts, ends, part): code points, and each pre-token's bounds and part.

    A special string is one point above END, END + 1 + its place among the special strings."""
    order = {s: END + 1 + i for i, s in enumerate(vocabulary.special)}
    stop = END.to_bytes(4, "little")
    coded = [p.encode("utf-32-le") if isinstance(p, str) else order[p[0]].to_bytes(4, "little") for p in parts]
    points = np.frombuffer(stop + stop.join(coded) + stop * 3, np.uint32)
    kind = classes()[points]
    if (kind == UNSURE).any():
        for point in np.unique(points[kind == UNSURE]):
            kind[points == point] = classes()[point] = vocabulary.settle(int(point))
    first = np.ones(len(points), bool)
    first[1:] = kind[1:] != kind[:-1]
    blank = points == 0x20
    solid = kind < SPACE  # letters, numbers, others
    solid_start = first & solid
    # the white space before a solid run: its last mark stands alone, or joins the run if it is a blank
    before = np.zeros(len(points), bool)
    before[:-1] = solid_start[1:] & (kind[:-1] == SPACE)
    bounds = first | before
    bounds[1:] &= ~(solid_start[1:] & blank[:-1])
    quotes = np.nonzero((points == 0x27) & bounds & solid_start)[0]
    if len(quotes):
        following = [points[quotes + 1], points[quotes + 2]]
        for suffix in SUFFIXES:
            hit = np.logical_and.reduce([following[i] == ord(c) for i, c in enumerate(suffix)])
            at = quotes[hit]
            bounds[at + 1] = False
            bounds[at + 1 + len(suffix)] = True
    starts = np.nonzero(bounds)[0]
    ends = np.append(starts[1:], len(points))
    keep = kind[starts] != BREAK
    starts, ends = starts[keep], ends[keep]
    lengths = np.fromiter((len(c) // 4 + 1 for c in coded), np.int64, len(coded))
    offsets = np.cumsum(lengths) - lengths + 1
    return points, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every span, one span after another."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)


def keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span, equal for equal spans; never 0. Two different spans among n share a key
    with probability of about n^2 / 2^65."""
    up, down = powers(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(marks()[points] * up[: len(points)], out=total[1:])
    key = (total[ends] - total[starts]) * down[starts]
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    return key | np.uint64(1)


class Table:
    """Open addressing from keys to numbers, bounded: it starts anew when it is full."""

    def __init__(self, entries: int = ENTRIES):
        self.entries = entries
        self.clear()

    def clear(self) -> None:
        size = 1 << max(10, (2 * self.entries - 1).bit_length())
        self.key, self.value, self.used, self.mask = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0, np.uint64(size - 1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        found = np.full(len(wanted), -1, np.int32)
        at = (wanted >> np.uint64(1)) & self.mask
        held = self.key[at]
        same = held == wanted
        found[same] = self.value[at[same]]
        left = np.nonzero(~same & (held != 0))[0]
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            held = self.key[at[left]]
            same = held == wanted[left]
            found[left[same]] = self.value[at[left[same]]]
            left = left[~same & (held != 0)]
        return found

    def add(self, new: np.ndarray, numbers: np.ndarray) -> None:
        """new: distinct keys that are not in the table."""
        left, at = np.arange(len(new)), (new >> np.uint64(1)) & self.mask
        while len(left):
            free = left[self.key[at[left]] == 0]
            _, once = np.unique(at[free], return_index=True)
            put = free[once]
            self.key[at[put]], self.value[at[put]] = new[put], numbers[put]
            left = left[self.key[at[left]] != new[left]]
            at[left] = (at[left] + np.uint64(1)) & self.mask
        self.used += len(new)


def looked_up(table: Table, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, compute: Callable[[list[str]], np.ndarray], fresh: Callable[[], None] | None = None) -> np.ndarray:
    """The number of each span: from the table, or computed once for each new distinct span."""
    key = keys(points, starts, ends)
    if table.used > table.entries:
        table.clear()
        if fresh:
            fresh()
    found = table.find(key)
    missing = np.nonzero(found < 0)[0]
    if len(missing):
        new, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
        spans = missing[first]
        sizes = ends[spans] - starts[spans]
        joined = points[ragged(starts[spans], sizes)].tobytes().decode("utf-32-le")
        stops = np.cumsum(sizes).tolist()
        numbers = compute([joined[a:b] for a, b in zip([0, *stops], stops)])
        table.add(new, numbers)
        found[missing] = numbers[back]
    return found
