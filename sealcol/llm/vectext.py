"""Columnar text kernels: words, hashes and windows of many texts at once, with numpy over Arrow buffers.

A word is a maximal run of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. In UTF-8 that is a
class of single bytes, so words are found without decoding: every kernel here works on the raw bytes of a batch.
Memory is bounded by cutting batches into chunks of about ``CHUNK`` bytes of text, one row at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; the arrays made from them take some fifty times as much.
CHUNK = 1 << 20

#: The word rule as a regular expression over A-Z-lowered text, for SQL, Java and Python alike.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte -> its lower-cased value inside a word, or 0.
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTE[0x80:] = np.arange(0x80, 0x100)

BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        tables = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            tables.append(np.cumprod(step, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some rows. Word i has hash ``h[i]`` and bytes ``low[start[i]:end[i]]``; row r has words ``ptr[r]:ptr[r+1]``."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    low: np.ndarray

    def __len__(self) -> int:
        return len(self.h)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def text(self, first: int, n: int) -> bytes:
        """n words from word ``first`` on, joined by single spaces."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[first : first + n], self.end[first : first + n]))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n+1 row offsets into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not wide and not pa.types.is_string(texts.type) and not pa.types.is_binary(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def find_words(raw: np.ndarray, offs: np.ndarray) -> Words:
    low = WORD_BYTE[raw]
    inside = low != 0
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64), low)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offs[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Words(h, start, end, np.searchsorted(start, offs), low)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all runs of n words inside a row."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = w.h[:m].copy()
    for j in range(1, n):
        g *= STEP
        g += w.h[j : j + m]
    row = w.row
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return at, mix(g[at])


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of about ``size`` bytes, whole rows each."""
    raw, offs = buffers(texts)
    a = 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def member(x: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions in x whose value is in the sorted table; ``bits`` = bitmap(table)."""
    at = np.flatnonzero(bits[(x & np.uint64(len(bits) - 1)).astype(np.int64)])
    if not len(at) or not len(table):
        return at[:0]
    k = np.searchsorted(table, x[at])
    k[k == len(table)] = 0
    return at[table[k] == x[at]]


def bitmap(table: np.ndarray) -> np.ndarray:
    size = 1 << max(12, int(len(table) * 16 - 1).bit_length())
    bits = np.zeros(min(size, 1 << 24), bool)
    bits[(table & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return bits
