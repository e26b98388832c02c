"""Repeated substrings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Suffix starts of text (symbols 0..256) sorted by their first ``least`` symbols, by prefix doubling."""
    n = len(text)
    rank = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    for k in range(7):  # seven symbols of nine bits
        rank = rank << 9 | padded[k : n + k]
    width = 7
    while True:
        order = np.argsort(rank, kind="stable")
        s = rank[order]
        new = np.ones(n, bool)
        new[1:] = s[1:] != s[:-1]
        if width >= least or new.all():
            return order
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new)
        after = np.zeros(n, np.int64)
        after[:-width] = dense[width:]
        rank = dense * (n + 1) + after if n > width else dense * (n + 1)
        width *= 2


def repeated_starts(text: np.ndarray, least: int) -> np.ndarray:
    """Flags of the starts of substrings of ``least`` symbols that occur twice or more in text.

    Common prefix lengths of neighbouring suffixes appear in rising order: the
    interval of a string w of length l is extended backward by every symbol c
    before it, and the right border of cw's interval, if it is new, has common
    prefix length l. The expansion stops at ``least``; a border that is still
    unknown then joins suffixes that agree on ``least`` symbols or more.
    """
    if len(text) < 2:
        return np.zeros(len(text), bool)
    text = np.append(text + 1, 0)  # an end that is less than all and occurs once
    n = len(text)
    out = np.zeros(n, bool)
    order = suffix_order(text, least + 1)
    bwt = text[order - 1].astype(np.int64)
    by_symbol = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)  # the suffix one symbol longer
    to[by_symbol] = np.arange(n)
    same = np.empty(n, bool)
    same[0] = False
    same[1:] = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before, behind = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    at = np.flatnonzero(same)
    before[by_symbol[at]] = by_symbol[at - 1]
    behind[by_symbol[at - 1]] = by_symbol[at]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(least):
        size = hi - lo
        idx = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        first = to[idx[before[idx] < np.repeat(lo, size)]]
        last = to[idx[behind[idx] >= np.repeat(hi, size)]]
        first.sort()  # intervals of different strings are apart: both ends sort alike
        last.sort()
        last += 1
        new = ~known[last]
        lo, hi = first[new], last[new]
        known[hi] = True
        if not len(lo):
            break
    joined = np.flatnonzero(~known)
    out[order[joined]] = True
    out[order[joined - 1]] = True
    return out[:-1]
