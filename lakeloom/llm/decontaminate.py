"""Benchmark decontamination with one FM-index per training shard.

Each shard of documents becomes a sequence of word numbers with an FM-index: its
Burrows-Wheeler transform in a wavelet tree. Benchmark phrases are found by backward
search through the tree's ranks, located by sampled suffix positions, and the words they
cover merge into removal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import fresh, map_arrow, spread
from lakeloom.llm.suffix import suffix_array

#: Fixed words of a text, once A-Z is lower case: runs outside ASCII's other characters.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A shard's characters, about; it bounds a task's memory.
SHARD = 2_000_000
#: Every so many positions keep their place; documents' first words always do.
SAMPLE = 16
#: Bytes of benchmark text searched at a time; more is searched in further passes over the same rows.
BLOCK = 4_000_000


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class Wavelet:
    """A wavelet tree in level order: the numbers' bits, highest first, each level sorted stably by the bits above."""

    def __init__(self, numbers: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        v = numbers.astype(np.int32)
        for k in range(self.bits - 1, -1, -1):
            b = (v >> k) & 1
            ones = np.zeros(len(v) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(v) - int(ones[-1]))
            up = b.astype(bool)
            v = np.concatenate([v[~up], v[up]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each number c occurs before place i."""
        a = np.zeros(len(i), np.int64)
        for k, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            one = (c >> k) & 1 == 1
            ra, ri = ones[a], ones[i]
            a = np.where(one, zeros + ra, a - ra)
            i = np.where(one, zeros + ri, i - ri)
        return i - a

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at each place, and how often it occurs before."""
        a, c = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[i + 1] - ones[i] == 1
            ra, ri = ones[a], ones[i]
            a = np.where(one, zeros + ra, a - ra)
            i = np.where(one, zeros + ri, i - ri)
            c = c * 2 + one
        return c, i - a


class FMIndex:
    """Finds phrases in a sequence of texts; each text ends in number 0, and phrases have numbers from 1 up."""

    def __init__(self, s: np.ndarray, top: int):
        n, ends = len(s), s == 0
        sa = suffix_array(s)
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))]).astype(np.int64)
        self.tree = Wavelet(s[sa - 1], top)
        starts = np.concatenate([[True], ends[:-1]])
        kept = (sa % SAMPLE == 0) | starts[sa]
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = sa[kept]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase, aligned to the right in its matrix row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for t in range(1, phrases.shape[1] + 1):
            live = live[(size[live] >= t) & (high[live] > low[live])]
            if not len(live):
                break
            c = phrases[live, -t]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a row whose position was kept."""
        out, left = np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows, steps = rows.copy(), 0
        while len(left):
            r = rows[left]
            done = self.kept[r + 1] > self.kept[r]
            out[left[done]] = self.places[self.kept[r[done]]] + steps
            left, r = left[~done], r[~done]
            c, k = self.tree.access(r)
            rows[left] = self.before[c] + k
            steps += 1
        return out


class Phrases:
    """The windows of benchmark items, numbered over their own words, each once."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.number: dict[bytes, int] = {}
        rows, owner = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
        self.items = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            n = np.array([self.number.setdefault(x, len(self.number) + 2) for x in w], np.int32)  # 1: any other word
            # aligned to the right; 0 is no word
            n = n if len(n) >= size else np.concatenate([np.zeros(size - len(n), np.int32), n])
            rows.append(np.lib.stride_tricks.sliding_window_view(n, size))
            owner.append(np.full(len(rows[-1]), place.get(item, -1)))
        self.matrix, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.size = (self.matrix > 0).sum(1)
        who = np.concatenate(owner)
        # windows of items without an id are searched like any other, and name no item
        pairs = np.unique(np.stack([of.ravel()[who >= 0], who[who >= 0]], 1), axis=0)
        self.item_of = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.matrix) + 1))

    def find(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: words, spans [start, end) of hit words, items with a window in it."""
        number = self.number
        parts, counts = [], []
        for t in texts:
            w = words(t)
            counts.append(len(w))
            parts.append(np.fromiter(map(number.get, w, repeat(1)), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))
        n = np.array(counts, np.int64)
        out: list[tuple[int, list, list]] = [(c, [], []) for c in counts]
        if not len(self.matrix) or not texts:
            return out
        full = np.concatenate(parts)
        # other words in a row say no more than one of them
        keep = np.ones(len(full), bool)
        keep[1:] = (full[1:] != 1) | (full[:-1] != 1)
        at = np.flatnonzero(keep)
        index = FMIndex(full[at], len(number) + 1)
        low, high = index.search(self.matrix, self.size)
        hits = high - low
        window = np.repeat(np.arange(len(hits)), hits)
        if not len(window):
            return out
        start = at[index.locate(spread(low, hits))]
        cover = np.zeros(len(full) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + self.size[window], -1)
        hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        base = np.concatenate([[0], np.cumsum(n + 1)])
        for a, b in edges.reshape(-1, 2).tolist():
            d = int(np.searchsorted(base, a, side="right")) - 1
            out[d][1].append((a - int(base[d]), b - int(base[d])))
        doc = np.searchsorted(base, start, side="right") - 1
        k = self.item_at[window + 1] - self.item_at[window]
        pairs = np.unique(np.repeat(doc, k) * len(self.items) + self.item_of[spread(self.item_at[window], k)])
        for p in pairs.tolist():
            out[p // len(self.items)][2].append(self.items[p % len(self.items)])
        return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; a line break marks each cut."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


_READY: dict[int, Phrases] = {}


def _phrases(items: list[tuple[str | None, str]], size: int) -> Phrases:
    key = hash((*items, size))
    if key not in _READY:
        if len(_READY) > 3:
            _READY.clear()
        _READY[key] = Phrases(items, size)
    return _READY[key]


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def _scan(benchmark, size: int, text: str, found: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what the benchmark's windows hit to column ``found``; shards are cut from each batch."""
    p = _phrases(benchmark, size)
    for b in batches:
        texts, old = b[text].to_pylist(), b[found].to_pylist()
        got, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and chars < SHARD:
                chars += len(texts[end] or "")
                end += 1
            got += p.find(texts[at:end])
            at = end
        rows = []
        for g, o in zip(got, old):
            spans, items = g[1], g[2]
            if o and o["spans"]:
                spans = _merge([(s["start"], s["end"]) for s in o["spans"]], spans)
                items = sorted({*o["items"], *items})
            rows.append({"n_words": g[0], "spans": [{"start": s, "end": e} for s, e in spans], "items": items})
        names = b.schema.names
        yield pa.RecordBatch.from_arrays([pa.array(rows, _FOUND) if c == found else b.column(i) for i, c in enumerate(names)], names)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, block: int = BLOCK) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: n_words, spans of hit words and the items found.

    Every run of ``size`` words of an item is searched, or a shorter item whole, in every
    document, whole. The benchmark's bytes are summed first; up to about ``block`` of them
    travel to the tasks at once, and more are searched in further passes over the same
    rows, so what a task holds is bounded (an item is in one pass). Null text has no words.
    Empty tables find nothing. Repeated rows are searched each. Items without an id are
    searched but not named; items without words have no windows.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    found = fresh(docs, "_found")
    out = docs.withColumn(found, F.lit(None).cast(_FOUND_DDL))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] or "", r[1]))
        out = map_arrow(out, partial(_scan, rows, size, "text", found), out.schema)
    return out, found


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, spans, items, contaminated."""
    f, found = find_benchmark(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, **options)
    hit = F.aggregate(f"{found}.spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return f.select("doc_id", F.col(f"{found}.n_words").alias("n_words"), hit.alias("n_hit"), F.col(f"{found}.spans").alias("spans"), F.array_sort(f"{found}.items").alias("items"), (F.size(f"{found}.spans") > 0).alias("contaminated"))


def _cut(found: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, texts = [], []
        for t, f in zip(b["text"].to_pylist(), b[found].to_pylist()):
            spans = [(s["start"], s["end"]) for s in f["spans"]]
            gone = bool(spans) and sum(e - s for s, e in spans) == f["n_words"]
            keep.append(not gone)
            texts.append(cut_words(t, spans) if spans else t)
        names = [c for c in b.schema.names if c != found]
        out = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(b.schema.names.index(c)) for c in names], names)
        yield out.filter(pa.array(keep, pa.bool_()))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs, same columns, with the removal spans cut from their texts.

    Documents without a hit stay as they are; one whose every word is hit goes.
    """
    f, found = find_benchmark(docs, benchmark, **options)
    return map_arrow(f, partial(_cut, found), docs.schema)
