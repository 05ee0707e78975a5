"""Words and their hashes, for whole Arrow blocks at once in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 equals
the pattern [^\\x20\\x09-\\x0D]+ on characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Longer words are hashed one at a time.
_LONG = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random word for each byte value; folded: A-Z share those of a-z.
BYTE_HASH = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
FOLDED_HASH = BYTE_HASH.copy()
FOLDED_HASH[65:91] = BYTE_HASH[97:123]


@dataclass
class Words:
    """Words of a block: byte position, length, row, hash; first[r] is the first word of row r."""

    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    n = len(data)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, length, row, first, word_hashes(data, start, length, fold))


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, fold: bool) -> np.ndarray:
    table = FOLDED_HASH if fold else BYTE_HASH
    h = length.astype(np.uint64) * _ODD
    live = np.arange(len(start))
    for k in range(int(min(_LONG, length.max(initial=0)))):
        live = live[length[live] > k]
        h[live] = h[live] * np.uint64(0xD6E8FEB86659FD93) + table[data[start[live] + k]]
    for i in np.flatnonzero(length > _LONG):
        word = data[start[i] : start[i] + length[i]].tobytes()
        h[i] = xxhash.xxh3_64_intdigest(word.lower() if fold else word)
    return mixed(h)


def rolled(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 entries are missing."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    out = word[: len(word) - n + 1].copy()
    for k in range(1, n):
        out *= _ODD
        out += word[k : len(word) - n + 1 + k]
    return out


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each n-word window that lies within a row, and the window's hash."""
    h = rolled(w.hash, n)
    at = np.flatnonzero(w.row[: len(h)] == w.row[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    return at, mixed(h[at])


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags (bytes or words) within each row's range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
