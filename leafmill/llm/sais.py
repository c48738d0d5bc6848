"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Types, leftmost-smaller positions, bucket bounds and names are computed in numpy; only the two induction scans, whose every
step depends on the one before, are loops. They touch each suffix once: time and space are linear.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``text`` (non-negative integers) in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    _, dense = np.unique(text, return_inverse=True)
    closed = np.zeros(n + 1, np.int64)
    closed[:n] = dense + 1
    return _induced(closed)[1:]


def _induced(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s``, whose last symbol is 0 and occurs once, over symbols 0..max without wide gaps."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    # classify: a suffix is smaller than its right neighbour (S) or larger (L); equal symbols follow the next unequal pair
    step = np.sign(s[1:] - s[:-1])
    decided = np.flatnonzero(step)
    smaller = np.ones(n, dtype=bool)
    smaller[:-1] = step[decided[np.searchsorted(decided, np.arange(n - 1))]] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    count = np.bincount(s)
    tails = np.cumsum(count)
    heads = tails - count
    # what stands before each suffix, or -1 if the scan must not induce it; the last entry answers for empty slots (-1)
    before_l = np.full(n + 1, -1, np.int64)
    before_s = before_l.copy()
    before_l[1:n] = np.where(smaller[:-1], -1, s[:-1])
    before_s[1:n] = np.where(smaller[:-1], s[:-1], -1)
    left, right, heads, tails = before_l.tolist(), before_s.tolist(), heads.tolist(), tails.tolist()

    def induce(sorted_lms: np.ndarray) -> list[int]:
        sa = np.full(n, -1, np.int64)
        symbols = s[sorted_lms]
        order = np.argsort(symbols, kind="stable")
        by_symbol = symbols[order]
        last = np.searchsorted(by_symbol, by_symbol, side="right")
        ends = np.asarray(tails)[by_symbol]
        sa[ends - (last - np.arange(len(order)))] = sorted_lms[order]
        out = sa.tolist()
        at = heads.copy()
        for x in out:
            c = left[x]
            if c >= 0:
                h = at[c]
                out[h] = x - 1
                at[c] = h + 1
        at = tails.copy()
        for i in range(n - 1, -1, -1):
            x = out[i]
            c = right[x]
            if c >= 0:
                h = at[c] - 1
                out[h] = x - 1
                at[c] = h
        return out

    if len(lms) > 1:
        found = np.asarray(induce(lms), dtype=np.int64)
        is_lms = np.zeros(n + 1, dtype=bool)
        is_lms[lms] = True
        found = found[is_lms[found]]
        names, distinct = _names(s, lms, found)
        if distinct < len(lms):
            order = _induced(names)
        else:
            order = np.empty(len(lms), np.int64)
            order[names] = np.arange(len(lms))
        lms = lms[order]
    return np.asarray(induce(lms), dtype=np.int64)


def _names(s: np.ndarray, lms: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of the leftmost-smaller substring at each of ``lms``, in text order, given their sorted order; how many ranks there are."""
    n = len(s)
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    end = np.append(lms[1:], n - 1)
    place = index[found]
    length = end[place] - found
    same = np.zeros(len(found), dtype=bool)
    a, b = found[:-1], found[1:]
    alike = (length[:-1] == length[1:]) & (s[a] == s[b]) & (s[end[place[:-1]]] == s[end[place[1:]]])
    alive = np.flatnonzero(alike)
    k = 1
    while len(alive):  # symbol by symbol, over those still equal
        going = alive[length[alive] > k]
        same[alive[length[alive] <= k] + 1] = True
        alive = going[s[found[going] + k] == s[found[going + 1] + k]]
        k += 1
    ranks = np.cumsum(~same) - 1
    names = np.empty(len(lms), np.int64)
    names[place] = ranks
    return names, int(ranks[-1]) + 1


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, how many symbols its suffix shares with the one before it in the suffix array."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    phi, s, out, run = before.tolist(), [*text.tolist(), -1], [0] * n, 0
    for i in range(n):
        j = phi[i]
        if j < 0:
            run = 0
            continue
        x, y = i + run, j + run
        while x < n and y < n and s[x] == s[y]:
            x += 1
            y += 1
        run = x - i
        out[i] = run
        if run:
            run -= 1
    return np.asarray(out, dtype=np.int64)
