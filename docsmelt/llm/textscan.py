"""Vectorised text scanning: words, code point classes and rolling 64-bit hashes."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# The bytes that separate words, \x20 and \x09-\x0D.
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kind = np.array([unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)])
    table[kind == "L"] = LETTER
    table[kind == "N"] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


class _Powers:
    """Powers of the hash multiplier and of its inverse modulo 2**64, grown on demand."""

    size = 0

    @classmethod
    def upto(cls, n: int):
        if cls.size < n:
            cls.size = max(n, 1 << 16)
            ones = np.ones(cls.size, np.uint64)
            cls.up, cls.down = ones.copy(), ones.copy()
            cls.up[1:], cls.down[1:] = _MULTIPLIER, _INVERSE
            np.cumprod(cls.up, out=cls.up)
            np.cumprod(cls.down, out=cls.down)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbol_j * m**j over j < i, from which ``span_hash`` gets any span's hash."""
    up, _ = _Powers.upto(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the symbols in each [start, end); equal spans have equal hashes."""
    _, down = _Powers.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(_BYTE_SYMBOLS[data]), starts, ends)


def words(data: np.ndarray, offsets: np.ndarray):
    """Byte bounds of the words ``[^\\x20\\x09-\\x0D]+`` and each row's first word number.

    Returns (starts, ends, first) where row r has the words first[r]:first[r + 1].
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = WORD_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words with one space after each, as one buffer, with their new bounds."""
    lengths = ends - starts
    new = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = np.full(int(new[-1]), 0x20, np.uint8)
    if len(starts):
        keep = np.ones(len(out), bool)
        keep[new[1:] - 1] = False
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] = 1
        inside[ends] -= 1
        out[keep] = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return out, new[:-1], new[:-1] + lengths
