"""Suffix sorting of integer sequences, by prefix doubling over the suffixes still tied."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions of the suffixes of texts, in order.

    s holds the texts one after another, each ended by number 0; other numbers are positive.
    Ends count as different symbols, in the order of the texts and below all others, so no
    comparison passes the end of a text. With ``depth`` suffixes are ordered by that many
    symbols at least, and equal ones stand in any order.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(s.max()).bit_length())
    h = max(1, min(n, 62 // bits))
    key = s.astype(np.int64)
    ended = key == 0
    for j in range(1, h):
        key = key << bits
        # what follows an end does not matter
        key[: n - j] |= np.where(ended[: n - j], 0, s[j:])
        ended[: n - j] |= s[j:] == 0
        ended[n - j :] = True
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    first = np.ones(n, bool)
    # equal keys with an end inside differ by that end, and the stable sort has put them in its order
    first[1:] = (key[1:] != key[:-1]) | ended[sa[1:]]
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, at, 0))
    tied = ~first
    tied[:-1] |= ~first[1:]
    idx = np.flatnonzero(tied)
    while len(idx) and (depth is None or h < depth):
        sub = sa[idx]
        key = (rank[sub] << 32) | rank[np.minimum(sub + h, n - 1)]
        order = np.argsort(key, kind="stable")
        sub, key = sub[order], key[order]
        sa[idx] = sub
        first = np.ones(len(idx), bool)
        first[1:] = key[1:] != key[:-1]
        rank[sub] = idx[np.maximum.accumulate(np.where(first, np.arange(len(idx)), 0))]
        tied = ~first
        tied[:-1] |= ~first[1:]
        idx = idx[tied]
        h *= 2
    return sa
