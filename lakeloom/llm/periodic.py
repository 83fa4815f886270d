"""Periodic runs of words: a stretch that repeats a shorter one several times, and no longer.

Each text is a sequence of words. A run of period p holds a place of the harmonic grid of p and
the place p further on; the candidates are those pairs of places with equal words. Longest
common extensions on a grammar made by recompression give each candidate's exact run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACE, map_arrow
from lakeloom.llm.recompression import common_extension, grammar, mirrored

#: Words worked on at a time, unless one text has more; and bytes of text split at a time.
WORDS, BYTES = 300_000, 4_000_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after another, and where each text's begin (and the last's end)."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), SPACE)
    values, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(values), 0)
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return values.filter(real), before[offsets - offsets[0]]


def _grid(w: np.ndarray, longest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the harmonic grid whose words agree with those a period on.

    In a run of at least ``times`` periods the first (times - 1) periods agree so. One grid
    place is in the run early enough for a whole period to agree behind it (from three
    periods on), of which three words are compared.
    """
    places, periods = [], []
    for p in range(1, longest // times + 1):
        step = max(1, times - 2) * p
        n = (len(w) - 2 * p) // step + 1
        if n < 1:
            break
        i = np.flatnonzero(w[: (n - 1) * step + 1 : step] == w[p : p + (n - 1) * step + 1 : step]) * step
        if times > 2:
            for t in {p // 2, p - 1} - {0}:
                i = i[w[i + t] == w[i + t + p]] if len(i) else i
        if len(i):
            places.append(i)
            periods.append(np.full(len(i), p))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def runs_of(sequences: list[np.ndarray], times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of every run, ordered by sequence, start and period.

    Words are numbers from 0. A run has at least ``least`` words and ``times`` (2 or more) of
    its smallest period, and no neighbouring word goes on with it. Sequences may be empty.
    """
    none = (np.zeros(0, np.int64),) * 4
    if not sequences:
        return none
    sizes = np.array([len(s) for s in sequences])
    top = max((int(s.max()) + 1 for s in sequences if len(s)), default=0)
    # every sequence after a symbol of its own, and one at the end
    w = np.concatenate([x for k, s in enumerate(sequences) for x in (np.array([top + k]), s)] + [np.array([top + len(sequences)])])
    begins = np.append(0, np.cumsum(sizes + 1))[:-1] + 1
    i, p = _grid(w, int(sizes.max()), times)
    if not len(i):
        return none
    # only what holds a candidate goes into the grammar
    seq = np.searchsorted(begins, i, side="right") - 1
    part = np.unique(seq)
    inside = np.concatenate([np.arange(begins[k] - 1, begins[k] + sizes[k]) for k in part])
    moved = np.full(len(w), -1, np.int64)
    moved[inside] = np.arange(len(inside))
    a, b = moved[i], moved[np.minimum(i + p, len(w) - 1)]
    ok = (seq >= 0) & (b >= 0) & (np.searchsorted(begins, i + p, side="right") - 1 == seq)
    a, b, p, seq = a[ok], b[ok], p[ok], seq[ok]
    levels = grammar(np.append(w[inside], top + len(sequences)))
    m = len(levels[0].symbols)
    on = common_extension(levels, a, b)
    back = common_extension(mirrored(levels), m - a, m - b)  # from the words before
    start, length = a - back, b - a + on + back
    ok = length >= np.maximum(least, times * p)
    start, length, p, seq = start[ok], length[ok], p[ok], seq[ok]
    order = np.lexsort((p, length, start))  # the smallest period of a stretch comes first
    start, length, p, seq = start[order], length[order], p[order], seq[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p, seq = start[new], length[new], p[new], seq[new]
    start = start - moved[begins[seq]]
    order = np.lexsort((p, start, seq))
    return seq[order], start[order], length[order], p[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _chunks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts of like lengths, about WORDS words at a time."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths[order]) // WORDS)) + 1
    yield from (c for c in np.split(order, cuts) if len(c))


def _found(texts: pa.Array, times: int, least: int) -> list[pa.Array]:
    """n_words, runs and the text without them."""
    values, ends = words_of(texts)
    ids = values.dictionary_encode().indices.to_numpy().astype(np.int64)
    n = np.diff(ends)
    seq, start, length, period = [np.concatenate(c) for c in zip(*(_with_numbers(c, runs_of([ids[ends[k] : ends[k + 1]] for k in c], times, least)) for c in _chunks(n)))]
    order = np.lexsort((period, start, seq))
    seq, start, length, period = seq[order], start[order], length[order], period[order]
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, ends[seq] + start + period, 1)
    np.add.at(gone, ends[seq] + start + length, -1)
    keep = np.cumsum(gone)[:-1] == 0
    kept = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep))[ends].astype(np.int32)), values.filter(pa.array(keep)))
    runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(_RUN))
    at = np.append(0, np.cumsum(np.bincount(seq, minlength=len(n)))).astype(np.int32)
    return [pa.array(n), pa.ListArray.from_arrays(pa.array(at), runs), pc.binary_join(kept, " ")]


def _with_numbers(chunk: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return chunk[found[0]], *found[1:]


def _run(times: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False))
        edges = [0, *(np.flatnonzero(np.diff(sizes // BYTES)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *_found(part["text"], times, least)], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """The periodic runs of every whole text (doc_id, text), and the text with each run's repeats dropped.

    Per row: doc_id, n_words, runs (start, length, period by start and period, words numbered
    from 0), collapsed (the words that no run holds behind its first period, joined by one
    blank). Words stand between ASCII white space. A run has ``times`` (2 or more) of its
    smallest period and ``least`` words at least. Null, empty and blank texts have no words,
    no runs and an empty collapsed text. Rows are worked on one by one: equal doc_ids, null
    ones and repeated rows stay as they are; other columns are left out. No shuffle.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return map_arrow(d, partial(_run, times, least), f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text; in about one document in ten the text repeats a stretch from some word on.

    With h the CRC-32 of the decimal doc_id and g = h div 10: if h mod 10 is 0 and there are n > 0
    words, word i >= a is word a + (i - a) mod p of before, a = g mod n, p = 1 + (n - a) div
    (3 + g mod 8); such a text's words are joined by one blank. A null doc_id is left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", h)
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", SPACE), lambda x: x != "")))
    d = d.withColumns({"g": F.floor(F.col("h") / 10), "n": F.coalesce(F.size("w"), F.lit(0)).cast("bigint")})
    d = d.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")))
    d = d.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    d = d.withColumn("place", F.when(F.col("n") > 0, place))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("place", lambda i: F.get("w", i.cast("int"))), " ")).otherwise(F.col("text")).alias("text"))
