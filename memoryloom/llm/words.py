"""Words, word hashes and shingle hashes of UTF-8 bytes, vectorised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(29)
#: A worker forgets its word hashes beyond this many, so that its memory is bounded.
WORDS_KEPT = 1 << 19


class WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = np.arange(256)
_FOLDED[0x41:0x5B] += 0x20
_LETTER = np.random.default_rng(20_240_301).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[_BREAK] = 0
_FOLDED_LETTER = _LETTER[_FOLDED]
#: Bytes that are hashed at once; a longer word is a block of its own.
BLOCK_BYTES = 1 << 20


def _powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Scale:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far."""

    ODD = 0xD1342543DE82EF95
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, BLOCK_BYTES + 1)
            cls.up, cls.down = _powers(size, cls.ODD), _powers(size, pow(cls.ODD, -1, 1 << 64))
        return cls.up, cls.down


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes begin and end (exclusive)."""
    edge = np.diff(_BREAK[data], prepend=True, append=True).nonzero()[0]
    return edge[::2], edge[1::2]


def hashed_words(texts: list[bytes | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of some texts, the texts' first words among them (and the end), and where each
    word begins and ends in the texts joined by one space.

    A word's hash is the polynomial of its bytes, each drawn from a table, then mixed. fold: A-Z count as a-z.
    """
    data = np.frombuffer(b" ".join([t or b"" for t in texts]), np.uint8)
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    start, end = word_places(data)
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    out = np.empty(len(start), np.uint64)
    table, at = _FOLDED_LETTER if fold else _LETTER, 0
    while at < len(start):
        first = start[at]
        stop = max(at + 1, int(np.searchsorted(start, first + BLOCK_BYTES)))
        last = end[stop - 1]
        up, down = _Scale.to(int(last - first))
        letters = table[data[first:last]]
        letters *= up[: len(letters)]
        places = start[at:stop] - first
        out[at:stop] = np.add.reduceat(letters, places) * down[places]
        at = stop
    out ^= out >> np.uint64(32)
    out *= _ODD
    out ^= out >> _FOLD
    return out, bounds, start, end


def byte_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose values have about most bytes together, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(sizes) else np.empty(0, np.int64)
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


class Table:
    """Non-negative 64-bit keys -> small numbers, looked up for whole arrays; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            _, first = np.unique(slots, return_index=True)
            mine = np.zeros(len(keys), bool)
            mine[first] = True
            mine &= free
            self.keys[slots[mine]], self.values[slots[mine]] = keys[mine], values[mine]
            keys, values, slots = keys[~mine], values[~mine], (slots[~mine] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, or -1."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slots[open_] = at = (slots[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (there >= 0)]
        return out


def spaced_words(text: bytes | None) -> list[bytes]:
    """The runs of bytes without space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.split() if text else []


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words; of all words, as one, where there are fewer (but not none)."""
    k = min(k, len(words))
    if not k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc ^= words[j : j + n]
        acc *= _ODD
        acc ^= acc >> _FOLD
    return acc
