"""A hashed maximum-entropy model of words: n-gram and skip features, class-factored softmax.

The model's outputs are the most frequent words and RARE groups of all others by their ending, dealt to
classes of WIDE. P(word) = P(class | context) x P(output | class, context), times, for a word of a rare group,
its share of the group's counts. A context's features are hashed to rows of two weight tables of fixed size.
Tasks train on their own documents by mini-batches; their rows are averaged by how often each was updated."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import xxhash

from tidegate.llm.pretokens import Table, keys

#: Outputs of a class, and classes. Class 0 holds the rare groups.
WIDE = 32
OUTPUTS = WIDE * WIDE
RARE = WIDE
#: Rows of the tables that give class scores and scores within a class; the first rows hold the biases.
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 16
#: Tokens of a mini-batch, and the step of the adaptive gradient.
BATCH, RATE = 8192, 0.08
#: Occurrences of a row in a mini-batch that are added place by place.
SHORT = 16
#: Context that comes before a text.
START = OUTPUTS
SEED = 42
#: The end of a text as a token: a byte that no word holds.
END = b"\n"
#: Words that a worker keeps before it starts anew.
KEPT = 1 << 19
#: Rows that travel together when tables are averaged.
BLOCK = 64


@lru_cache(maxsize=1)
def lowered() -> tuple[np.ndarray, np.ndarray]:
    """By byte: A-Z in lower case and all others as they are; whether it is ASCII white space."""
    byte = np.arange(256, dtype=np.uint8)
    return np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8), (byte == 32) | ((byte >= 9) & (byte <= 13))


def group_of(word: bytes) -> int:
    """The rare group of a word, by its ending without punctuation."""
    return xxhash.xxh32_intdigest((word.rstrip(b".,;:!?|)\"'") or word)[-3:], SEED) % RARE


def code_of(word: bytes) -> int:
    """The word's 64-bit hash as a signed number."""
    h = xxhash.xxh64_intdigest(word, SEED)
    return h - (1 << 64) if h >> 63 else h


class Lexicon:
    """Numbers for words as they come, with code and rare group of each; starts anew beyond `most` words.

    Words are found in the bytes of many texts at once, and keyed by a 64-bit hash; 0 is the end's number."""

    def __init__(self, most: int = KEPT):
        self.most, self.era = most, -1
        self.anew()

    def anew(self) -> None:
        self.era += 1
        self.table = Table(self.most)
        self.code, self.group = np.array([code_of(END)], np.int64), np.array([group_of(END)], np.int32)

    def __len__(self) -> int:
        return len(self.code)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, sizes): of all tokens one after another, and tokens of each text."""
        if len(self) > self.most:
            self.anew()
        coded = [t.encode() for t in texts]
        low, blank = lowered()
        raw = np.frombuffer(b"\n" + b"\n".join(coded) + b"\n", np.uint8)
        edges = np.nonzero(np.diff(blank[raw].view(np.int8)))[0] + 1
        starts, ends = edges[::2], edges[1::2]
        points = low[raw]
        key = keys(points, starts, ends)
        found = self.table.find(key)
        missing = np.nonzero(found < 0)[0]
        if len(missing):
            new, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            spans = missing[first]
            words = [points[a:b].tobytes() for a, b in zip(starts[spans].tolist(), ends[spans].tolist())]
            numbers = np.arange(len(self), len(self) + len(words), dtype=np.int32)
            self.table.add(new, numbers)
            found[missing] = numbers[back]
            self.code = np.append(self.code, np.array([code_of(w) for w in words], np.int64))
            self.group = np.append(self.group, np.array([group_of(w) for w in words], np.int32))
        offsets = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
        until = np.searchsorted(starts, offsets)
        return np.insert(found, until, 0), np.diff(until, prepend=0) + 1


@dataclass
class Model:
    """codes: the frequent words' hashes, sorted, with their outputs; class_w, word_w: the weight tables."""

    codes: np.ndarray
    outputs: np.ndarray
    class_w: np.ndarray = field(default_factory=lambda: np.zeros((CLASS_ROWS, WIDE), np.float32))
    word_w: np.ndarray = field(default_factory=lambda: np.zeros((WORD_ROWS, WIDE), np.float32))

    @classmethod
    def of_counts(cls, codes: np.ndarray, counts: np.ndarray, group_counts: np.ndarray) -> Model:
        """The model that knows no context: its biases give each output its share of the counts. codes: the
        frequent words by falling count, at most OUTPUTS - RARE of them."""
        order = np.argsort(codes)
        model = cls(codes[order], (np.arange(len(codes)) + RARE)[order])
        mass = np.full(OUTPUTS, 1e-4)
        mass[:RARE] += group_counts
        mass[RARE : RARE + len(codes)] += counts
        mass = mass.reshape(WIDE, WIDE)
        model.class_w[0] = np.log(mass.sum(axis=1) / mass.sum())
        model.word_w[:WIDE] = np.log(mass / mass.sum(axis=1, keepdims=True))
        return model

    def outputs_of(self, code: np.ndarray, group: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return group.astype(np.int32)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.outputs[at], group).astype(np.int32)


def scrambled(x: np.ndarray, tag: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(tag * 0x1000003 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def feature_rows() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the single-word features by what the word is: of the class table for the four words before, and
    of the other one, by word and class, for the three before."""
    value = np.arange(OUTPUTS + 1, dtype=np.uint64)
    each = [scrambled(value, n) for n in range(4)]
    kinds = scrambled(np.arange(WIDE), 77)
    within = [scrambled(m[:, None] + kinds[None, :], 5).ravel() for m in each[:3]]
    return (
        [(m % np.uint64(CLASS_ROWS - 1) + np.uint64(1)).astype(np.uint16) for m in each],
        [(m % np.uint64(WORD_ROWS - WIDE) + np.uint64(WIDE)).astype(np.uint16) for m in within],
    )


def rows_of(out: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(class rows, word rows) of every token, an array for each feature: the bias, the four words before and
    the pair before; and the bias of the class and the three words before."""
    starts = np.cumsum(sizes) - sizes
    before = []
    for n in range(1, 5):
        shifted = np.full(len(out), START, np.int32)
        shifted[n:] = out[: max(0, len(out) - n)]
        for k in range(n):  # the first tokens of a text have fewer words before them
            shifted[starts[sizes > k] + k] = START
        before.append(shifted)
    kind = out // WIDE
    by_class, within = feature_rows()
    pair = scrambled(before[0].astype(np.int64) * (OUTPUTS + 1) + before[1], 9)
    rows = [np.zeros(len(out), np.uint16), *[t[b] for t, b in zip(by_class, before)], (pair % np.uint64(CLASS_ROWS - 1) + np.uint64(1)).astype(np.uint16)]
    return rows, [kind.astype(np.uint16), *[t[b * WIDE + kind] for t, b in zip(within, before)]]


class Space:
    """Arrays that every mini-batch uses again: fresh ones of this size would cost more than the sums."""

    def __init__(self):
        self.total, self.part, self.power = (np.empty((BATCH, WIDE), np.float32) for _ in range(3))
        self.ranked = np.empty((7 * BATCH, WIDE), np.float32)

    def raised(self, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Exponentials of the sums of the features' rows, shifted by their largest where they would overflow."""
        n = len(rows[0])
        total, part = self.total[:n], self.part[:n]
        np.take(weights, rows[0], axis=0, out=total, mode="clip")
        for r in rows[1:]:
            np.take(weights, r, axis=0, out=part, mode="clip")
            total += part
        if total.max() > 60:
            total -= total.max(axis=1, keepdims=True)
        return np.exp(total, out=self.power[:n])

    def summed(self, slope: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, sum of its tokens' slopes, number of its tokens) for every row that occurs."""
        flat = np.concatenate(rows)
        order = np.argsort(flat, kind="stable")  # a radix sort, as rows have 16 bits
        ranked = flat[order]
        held = self.ranked[: len(flat)]
        np.take(slope, order % len(slope), axis=0, out=held, mode="clip")
        first = np.nonzero(np.append(True, ranked[1:] != ranked[:-1]))[0]
        sizes = np.diff(np.append(first, len(flat)))
        total = held[first]
        # Most rows occur a few times: those are added place by place, and only long runs one by one.
        for k in range(1, SHORT):
            more = np.nonzero(sizes > k)[0]
            total[more] += held[first[more] + k]
        for run in np.nonzero(sizes > SHORT)[0]:
            total[run] += held[first[run] + SHORT : first[run] + sizes[run]].sum(axis=0)
        return ranked[first], total, sizes


def log_shares(model: Model, out: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the probability of every token's output."""
    result, space = np.zeros(len(out)), Space()
    for weights, rows, aim in zip((model.class_w, model.word_w), rows_of(out, sizes), (out // WIDE, out % WIDE)):
        for at in range(0, len(out), BATCH):
            part = slice(at, at + BATCH)
            total = space.raised(weights, [r[part] for r in rows])
            share = total[np.arange(len(total)), aim[part]] / total.sum(axis=1)
            result[part] += np.log10(np.maximum(share, 1e-30))
    return result


class Trainer:
    """Adaptive-gradient training of a copy of a model, counting the updates of each row."""

    def __init__(self, model: Model):
        self.model = Model(model.codes, model.outputs, model.class_w.copy(), model.word_w.copy())
        self.squares = [np.full_like(model.class_w, 1e-2), np.full_like(model.word_w, 1e-2)]
        self.updates = [np.zeros(CLASS_ROWS), np.zeros(WORD_ROWS)]
        self.space = Space()

    def step(self, table: int, weights: np.ndarray, rows: list[np.ndarray], aim: np.ndarray) -> None:
        slope = self.space.raised(weights, rows)
        slope /= slope.sum(axis=1, keepdims=True)
        slope[np.arange(len(aim)), aim] -= 1.0
        hit, total, times = self.space.summed(slope, rows)
        squares = self.squares[table][hit]
        squares += total * total
        self.squares[table][hit] = squares
        total *= RATE
        total /= np.sqrt(squares, out=squares)
        weights[hit] -= total
        self.updates[table][hit] += times

    def learn(self, out: np.ndarray, sizes: np.ndarray) -> None:
        by_class, within = rows_of(out, sizes)
        for at in range(0, len(out), BATCH):
            part = slice(at, at + BATCH)
            self.step(0, self.model.class_w, [r[part] for r in by_class], out[part] // WIDE)
            self.step(1, self.model.word_w, [r[part] for r in within], out[part] % WIDE)
