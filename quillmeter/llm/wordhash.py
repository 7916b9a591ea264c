r"""Words ``[^\x20\x09-\x0D]+`` of whole Arrow columns and hashes of word runs, in numpy vectors.

A word's hash is a polynomial over random byte values modulo 2^64, mixed; prefix sums give all words' hashes at once.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_BASE = 0xBF58476D1CE4E5B9
#: Bytes whose words are hashed at once, and powers of the base and of its inverse up to there.
_CHUNK = 1 << 18
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = np.array([xxhash.xxh64_intdigest(bytes([b]), 42) for b in range(256)], np.uint64)


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_CHUNK - 1, base, np.uint64))))


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` consecutive words; empty if there are fewer words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= _STEP
        out += h[j : j + n]
    return mixed(out)


def sliding(op: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """np.minimum or np.maximum over each ``size`` consecutive values, by doubling."""
    n, have = len(x) - size + 1, 1
    while have < size:
        step = min(have, size - have)
        x, have = op(x[:-step], x[step:]), have + step
    return x[: max(n, 0)]


class Words:
    """The words of each value of a string or binary column without nulls.

    ``starts`` and ``ends`` are their byte ranges in ``data``; the words of row i are first[i] to first[i + 1].
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, offsets = _bytes_of(column)
        if lower:  # A-Z alone
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data + np.uint8(32), self.data)
        space = _SPACE[self.data]
        start = ~space
        start[1:] &= space[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[heads] = ~space[heads]
        end = ~space
        end[:-1] &= space[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[tails] = ~space[tails]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def rows(self, size: int) -> np.ndarray:
        """For each run of ``size`` words of the column its row, -1 if it crosses rows."""
        n = max(len(self.starts) - size + 1, 0)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return np.where(row[:n] == row[size - 1 : size - 1 + n], row[:n], -1)

    def joined(self, i: int) -> bytes:
        """The words of row i, joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        return b" ".join(self.slice(a, b).split()) if b > a else b""

    def slice(self, a: int, b: int) -> bytes:
        """The bytes from word a to before word b."""
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes() if b > a else b""

    @cached_property
    def hashes(self) -> np.ndarray:
        out, i, n = np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        while i < n:
            at = self.starts[i]
            j = int(np.searchsorted(self.ends, at + _CHUNK, side="right"))
            if j <= i:  # a word longer than a chunk
                out[i] = xxhash.xxh64_intdigest(self.data[at : self.ends[i]].tobytes(), 42)
                i += 1
                continue
            seg = self.data[at : self.ends[j - 1]]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[seg] * _POWER[: len(seg)])))
            a, b = self.starts[i:j] - at, self.ends[i:j] - at
            out[i:j] = mixed((total[b] - total[a]) * _INVERSE[a])
            i = j
        return out


class Index:
    """Places of 64-bit keys: a table over the top bits of the mixed keys, then a few steps through the sorted ones."""

    def __init__(self, keys: np.ndarray):
        m = mixed(keys.astype(np.uint64))
        self.order = np.argsort(m).astype(np.int32)
        self.sorted = m[self.order]
        bits = max(int(2 * len(keys)).bit_length(), 4)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.sorted, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.steps = int(np.diff(np.append(self.start, len(keys))).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For each key its place among the keys at the start, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.sorted) or not len(keys):
            return out
        m = mixed(keys.astype(np.uint64))
        at, left = self.start[m >> self.shift], np.arange(len(keys))
        for _ in range(self.steps):
            at = np.minimum(at, len(self.sorted) - 1)
            value = self.sorted[at]
            hit = value == m
            out[left[hit]] = self.order[at[hit]]
            more = value < m
            left, m, at = left[more], m[more], at[more] + 1
            if not len(left):
                break
        return out


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they come (or the sums of their counts)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and the n + 1 places where they start and end."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, kind = len(column), np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return flat, at - at[0]
