"""Recompression: a run-length grammar of a sequence, and longest common extensions on it.

Rounds alternate: a block of equal neighbours becomes one symbol, then pairs of a left and a
right symbol do. Equal symbols of a level stand for equal strings, and what a symbol is joined
with depends on its neighbours alone; so two equal stretches are made of the same symbols but
at their edges. An extension climbs while both sides stand at the start of a symbol's first
part, comparing one symbol or one block a level, and comes down again where symbols differ.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from lakeloom.llm.common import mix64


class Level(NamedTuple):
    """Symbols of a level; which symbol of the next each belongs to; where that one's parts begin."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    blocks: bool


def _named(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _joined(symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, blocks: bool) -> tuple[Level, np.ndarray]:
    begins = np.zeros(len(symbols), np.int64)
    begins[starts] = 1
    return Level(symbols, np.cumsum(begins) - 1, np.append(starts, len(symbols)), blocks), _named(keys)


def grammar(sequence: np.ndarray) -> list[Level]:
    """Levels from the sequence up to one whose symbols all differ, which has no parents.

    The sequence begins and ends with symbols that stand nowhere else.
    """
    s, out = _named(sequence), []
    while len(s) and (kinds := int(s.max()) + 1) < len(s):
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) < len(s):
            sizes = np.diff(np.append(starts, len(s)))
            level, s = _joined(s, starts, s[starts] * (len(s) + 1) + sizes, True)
            out.append(level)
            kinds = int(s.max()) + 1
        side = (mix64(s.astype(np.uint64) + np.uint64(len(out) << 40)) & np.uint64(1)).astype(bool)
        pair = side[:-1] & ~side[1:]
        other = ~side[:-1] & side[1:]
        if other.sum() > pair.sum():
            pair = other
        starts = np.flatnonzero(np.append(True, ~pair))
        after = np.zeros(len(s), np.int64)
        after[:-1][pair] = s[1:][pair] + 1
        level, s = _joined(s, starts, s[starts] * (kinds + 1) + after[starts], False)
        out.append(level)
    return [*out, Level(s, np.zeros(0, np.int64), np.zeros(0, np.int64), False)]


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the reversed sequence."""
    return [Level(v.symbols[::-1], (len(v.first) - 2 - v.parent)[::-1], (len(v.symbols) - v.first)[::-1], v.blocks) for v in levels]


def _left_in_block(v: Level, x: np.ndarray) -> np.ndarray:
    return v.first[v.parent[x] + 1] - x


def _advance(v: Level, x: np.ndarray, y: np.ndarray, go: np.ndarray) -> None:
    """Move on over the common symbols at x and y: a block's rest, or one symbol."""
    x_, y_ = x[go], y[go]
    step = np.minimum(_left_in_block(v, x_), _left_in_block(v, y_)) if v.blocks else 1
    x[go], y[go] = x_ + step, y_ + step


def common_extension(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from a[i] on equal those from b[i] on, for every i; a[i] and b[i] differ."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    stop = np.full(len(x), len(levels) - 1)
    live = np.arange(len(x))
    for n, v in enumerate(levels[:-1]):
        if not len(live):
            break
        p, q = x[live], y[live]

        def aligned() -> np.ndarray:
            return (v.first[v.parent[p]] == p) & (v.first[v.parent[q]] == q)

        _advance(v, p, q, ~aligned() & (v.symbols[p] == v.symbols[q]))
        up = aligned()
        x[live], y[live] = np.where(up, v.parent[p], p), np.where(up, v.parent[q], q)
        stop[live[~up]] = n
        live = live[up]
    for n in range(len(levels) - 2, -1, -1):
        v, live = levels[n], np.flatnonzero(stop > n)
        p, q = v.first[x[live]], v.first[y[live]]
        _advance(v, p, q, v.symbols[p] == v.symbols[q])
        x[live], y[live] = p, q
    return x - a
