"""Whole Arrow batches of texts as byte arrays: words, word hashes and shingles without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Space and U+0009 to U+000D part words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: All but ASCII digits, ASCII letters and what is outside ASCII parts words.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit of the input moves all of the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Texts:
    """``data``: the UTF-8 bytes of all texts, one after another; text i is ``data[at[i]:at[i + 1]]``. Nulls are empty."""

    def __init__(self, array: pa.Array, lower: bool = False):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        array = array.cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        buffers = array.buffers()
        self.n = len(array)
        at = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(buffers[2] or b"", np.uint8)[at[0] : at[-1]]
        self.at = at - at[0]
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw

    def words(self, parts: np.ndarray = BLANK) -> "Words":
        return Words(self, parts)


class Words:
    """Words of all texts in order: ``start`` and ``end`` in bytes, ``first[i]`` the number of words before text i."""

    def __init__(self, texts: Texts, parts: np.ndarray):
        self.texts, data, at = texts, texts.data, texts.at
        inside = ~parts[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = at[1:-1]
            edge = edge[(edge > 0) & (edge < len(data))]
            begins[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes."""
        data = self.texts.data
        n = len(data)
        if not n:
            return np.zeros(0, U64)
        power = np.empty(n, U64)
        power[0] = 1
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * power, out=total[1:])
        power[0] = 1
        power[1:] = _BASE_INV
        np.multiply.accumulate(power, out=power)
        return mix((total[self.end] - total[self.start]) * power[self.start] + (self.end - self.start).astype(U64) * _STEP[0])

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words of one text, in order, and the number of windows before each text."""
        n = np.maximum(self.count - size + 1, 0)
        first = np.concatenate([[0], np.cumsum(n)])
        total = len(hashes) - size + 1
        if total <= 0 or not first[-1]:
            return np.zeros(0, U64), first
        all_of = hashes[:total] * _STEP[1]
        for k in range(1, size):
            all_of = all_of + hashes[k : k + total] * _STEP[1 + k % 60]
        begin = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], n)
        return mix(all_of[begin]), first

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Like windows; a text with words, but fewer than ``size``, has its whole sequence as its one shingle."""
        hashes = self.hashes()
        long, first = self.windows(hashes, size)
        n = np.diff(first)
        few = (self.count > 0) & (n == 0)
        if not few.any():
            return long, first
        out_first = np.concatenate([[0], np.cumsum(n + few)])
        out = np.empty(out_first[-1], U64)
        own = np.ones(len(out), bool)
        own[out_first[:-1][few]] = False
        out[own] = long
        for i in np.flatnonzero(few):
            h = _STEP[63] + U64(self.count[i])
            for w in hashes[self.first[i] : self.first[i + 1]]:
                h = mix(np.array([h * _BASE + w], U64))[0]
            out[out_first[i]] = h
        return out, out_first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and the number of values before each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(first)))
