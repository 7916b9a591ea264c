"""Suffix arrays by induced sorting, and common prefixes in text order, in numpy vectors."""

from __future__ import annotations

import numpy as np

#: Entries that one step of an induced scan takes at most.
FRONT = 1 << 16


def _small(x: np.ndarray, k: int) -> np.ndarray:
    """Symbols in 16 bits where they fit: those are sorted by radix."""
    return x.astype(np.uint16) if k <= 1 << 16 else x


def _grouped(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol; in it, each group's symbol and size, and each entry's place in its group."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    head = np.flatnonzero(np.concatenate((np.ones(1, bool), c[1:] != c[:-1])))
    size = np.diff(np.append(head, len(c)))
    return order, c[head].astype(np.int64), size, np.arange(len(c)) - np.repeat(head, size)


def _filled(slots: np.ndarray, p: int) -> int:
    """End of the filled run that begins at p, FRONT slots at most."""
    size = 64
    while True:
        part = slots[p : p + size]
        gap = int((part < 0).argmax()) if len(part) else 0
        if len(part) and part[gap] < 0:
            return p + gap
        if len(part) < size or size >= FRONT:
            return p + len(part)
        size *= 4


def _induce(slots: np.ndarray, free: np.ndarray, t: np.ndarray, wanted: np.ndarray) -> None:
    """Fills the slots from left to right: an entry i puts i - 1 into the next free slot of its symbol, if it is wanted.

    An entry's own slot comes before the one that it fills, so a filled run can be taken at once: its entries put theirs
    in the order of the run.
    """
    p, n = 0, len(slots)
    while p < n:
        q = _filled(slots, p)
        j = slots[p:q] - 1
        j = j[j >= 0]
        j = j[wanted[j]]
        if len(j):
            order, c, size, place = _grouped(t[j])
            slots[np.repeat(free[c], size) + place] = j[order]
            free[c] += size
        p = q


def _sorted_by_lms(t: np.ndarray, k: int, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, induced from leftmost S-type suffixes in the given order (whose symbols must not fall)."""
    chars = _small(t, k)
    n_all = np.bincount(t, minlength=k)
    n_s = np.bincount(t[s_type], minlength=k)
    n_l, n_lms = n_all - n_s, np.bincount(t[lms], minlength=k)
    # L-type suffixes and the leftmost S-type ones, in the order of the scan from the left
    start = np.concatenate(([0], np.cumsum(n_l + n_lms)))[:-1]
    slots = np.full(int(n_l.sum() + len(lms)), -1, np.int64)
    own = np.arange(len(lms)) - np.repeat(np.cumsum(n_lms) - n_lms, n_lms)
    slots[np.repeat(start + n_l, n_lms) + own] = lms
    _induce(slots, start.copy(), chars, ~s_type)
    l_sorted = slots[~s_type[slots]]
    # all suffixes from the right: reversed, so that this is a scan from the left as well
    stop = np.cumsum(n_all)
    n, slots = len(t), np.full(len(t), -1, np.int64)
    own = np.arange(len(l_sorted)) - np.repeat(np.cumsum(n_l) - n_l, n_l)
    slots[n - 1 - (np.repeat(stop - n_all, n_l) + own)] = l_sorted
    slots[n - 1] = n - 1  # the end of the text
    _induce(slots, n - stop, chars, s_type)
    return slots[::-1]


def _named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """For the leftmost S-type positions in text order the ranks of their substrings, equal ones alike.

    A substring reaches to the next such position, inclusive.
    """
    length = np.ones(len(t), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    a, b, size = a[same], b[same], length[a][same]
    new = np.ones(len(ordered), np.int64)
    new[0] = 0
    if len(a):
        head = np.cumsum(size) - size
        offset = np.arange(int(size.sum())) - np.repeat(head, size)
        equal = np.logical_and.reduceat(t[np.repeat(a, size) + offset] == t[np.repeat(b, size) + offset], head)
        new[1:][same] = ~equal
    rank = np.empty(len(t), np.int64)
    rank[ordered] = np.cumsum(new)
    return rank[lms]


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffixes' places in order, by induced sorting. ``t`` has symbols under ``k``; its last is 0, and no other one is.

    Suffixes are S-type (smaller than the next) or L-type. The substrings between leftmost S-type positions are sorted by
    inducing and named; if names repeat, the text of names is sorted in the same way. Its order induces that of all.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    s_type = np.ones(n, bool)
    s_type[:-1] = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    first = _sorted_by_lms(t, k, s_type, lms[np.argsort(_small(t[lms], k), kind="stable")])
    leftmost = np.zeros(n, bool)
    leftmost[lms] = True
    ordered = first[leftmost[first]]
    names = _named(t, lms, ordered)
    kinds = int(names.max()) + 1
    if kinds < len(lms):
        ordered = lms[suffix_array(names, kinds)]
    return _sorted_by_lms(t, k, s_type, ordered)


def common_prefixes(t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in the text the suffix before it in the order (-1: none), and the length of their common prefix.

    A place whose left neighbour symbol equals that of its partner has one less than the place before; all others are
    compared, eight symbols at a time. ``t`` is of bytes and ends with its only 0.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    i = np.arange(n)
    has = before >= 0
    own = has.copy()
    own[1:] &= (t[:-1] != t[before[1:] - 1]) | (before[1:] <= 0) | ~has[:-1]
    first = np.flatnonzero(own)
    out[first] = _compared(t, first, before[first])
    head = np.maximum.accumulate(np.where(own, i, 0))
    out = np.where(has, out[head] - (i - head), 0)
    return before, out


def _compared(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    padded = np.concatenate((t.astype(np.uint8), np.zeros(16, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    eight = np.ascontiguousarray(eight[: len(t) + 8]).view("<u8").ravel()
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
        done = x != 0
        low = x[done] & (~x[done] + np.uint64(1))  # the lowest bit that differs
        out[live[done]] += np.searchsorted(np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64), low, side="right")
        live = live[~done]
        out[live] += 8
    return out
