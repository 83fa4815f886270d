"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = {i: i + 32 for i in range(65, 91)}


def low(t: str | None) -> str:
    return (t or "").translate(_LOW)


def repeats(texts: list[str | None], size: int = 200) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                cover[i : i + size] = b"\1" * size
        runs = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, bytes(x for x, c in zip(b, cover) if not c)))
    return out


def shingles(t: str | None, k: int = 5) -> frozenset:
    w = WORD.findall(low(t))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near(rows: list[tuple[int | None, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def benchmark_hits(texts: list[str | None], items: list[tuple[object, str | None]], size: int = 10) -> list[tuple[int, set[int], set[str]]]:
    windows = defaultdict(set)
    for i, t in items:
        w = BENCH_WORD.findall(low(t))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])] |= set() if i is None else {str(i)}
    out = []
    for t in texts:
        w, hit, found = BENCH_WORD.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((len(w), hit, found))
    return out


def base_stats(t: str | None) -> tuple[int, int, int, int, int, bool]:
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def talk_digest(turns: list[tuple[str | None, str | None]]) -> tuple[int, str, int, str]:
    h, loss, n = hashlib.sha256(), hashlib.sha256(), 0
    for role, text in turns:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            loss.update((text or "").encode())
            n += len(text or "")
    return len(turns), h.hexdigest(), n, loss.hexdigest()


def url_scores(rows: list[tuple[str, str | None]], order: int = 5, doubt: float = 4.0) -> list[float]:
    """Scores of (text, allow, block or None to leave out of the models) by counts in dictionaries."""
    seen = {"allow": Counter(), "block": Counter()}
    grams = lambda t: [[(None,) * max(0, k - i) + tuple(s[max(0, i - k) : i + 1]) for k in range(order + 1)] for s in [[*t.encode(), -1]] for i in range(len(s))]
    for t, side in rows:
        if side:
            for g in grams(t):
                for k, x in enumerate(g):
                    seen[side][x] += 1
                    seen[side]["context", k, x[:-1]] += 1

    def log_p(side, g):
        p = 1 / 256
        for k, x in enumerate(g):
            total = seen[side]["context", k, x[:-1]]
            w = total / (total + doubt)
            p = w * seen[side][x] / max(total, 1) + (1 - w) * p
        return math.log(p)

    return [sum(log_p("allow", g) - log_p("block", g) for g in gs) / len(gs) for gs in (grams(t) for t, _ in rows)]


def url_threshold(scored: list[tuple[float, bool]], step: float = 0.002) -> float:
    """The middle of the thresholds, on a grid, with the best mean of both hit rates."""
    good, bad = [s for s, g in scored if g], [s for s, g in scored if not g]
    if not good or not bad:
        return 0.0
    edges = [(b - 0.5) * step for b in range(-2000, 2002)]
    gain = [sum(s < e for s in bad) / len(bad) + sum(s >= e for s in good) / len(good) for e in edges]
    best = [i for i, g in enumerate(gain) if g >= max(gain) - 1e-12]
    return ((best[0] + best[-1]) / 2 - 2000 - 0.5) * step


def near_by_prefix(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, int]:
    """doc_id -> component, exact for larger tables: linked sets share one of their rarest shingles."""
    sets = {i: shingles(t) for i, t in rows}
    often = Counter(x for s in sets.values() for x in s)
    groups: dict[frozenset, int] = {}
    up: dict[int, int] = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i in sorted(sets):
        up[i] = groups.setdefault(sets[i], i) if sets[i] else i
    at = defaultdict(list)
    for s, i in groups.items():
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in rare for j in at[x]}:
            other = sets[j]
            k = len(s & other)
            if 100 * k >= percent * (len(s) + len(other) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for x in rare:
            at[x].append(i)
    return {i: root(i) for i in sets}
