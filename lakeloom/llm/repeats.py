"""Removal of long repeated byte strings through a Burrows-Wheeler transform.

Every window of ``size`` bytes is dealt to the rarest-looking k-gram inside it (the least
hash, its anchor), so equal windows meet wherever they stand. Only stretches whose anchor
occurs again go on; equal stretches merge, and the distinct ones of an anchor form a text
whose transform is extended backward, breadth first. That sets the common prefixes of
neighbouring suffixes by increasing value; extension stops at ``size``, and suffixes whose
common prefix is still open repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lakeloom.llm.common import cut, free_shuffles, fresh, map_arrow, mix64, release, spread, spread_join, text_or_empty
from lakeloom.llm.suffix import suffix_array

_U = np.uint64
#: Bytes of an anchor's k-gram.
GRAM = 32
#: Bytes worked on at a time; a piece's positions fit in the low bits of a key.
_PIECE, _BITS = 400_000, 21
#: Bytes of text in one transform, about; and the most that one anchor may bring to it.
BLOCK, HOT = 500_000, 4_000_000
#: How often the stretches of an anchor that brings more are dealt anew, by further anchors.
LEVELS = 6


def _grams(buf: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position."""
    n = len(buf) - 7
    raw = buf.tobytes()
    words = np.empty(n, np.uint64)
    for j in range(8):
        part = np.frombuffer(raw, "<u8", count=(len(buf) - j) // 8, offset=j)
        words[j::8] = part[: len(words[j::8])]
    m = len(buf) - GRAM + 1
    h = words[:m] * _U(0x9E3779B97F4A7C15)
    for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> _U(29)
        h += words[k : k + m]
        h *= _U(c)
    return mix64(h)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    m, w = key, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(key) - width + 1], m[width - w : width - w + len(key) - width + 1])


_R = 0xD1342543DE82EF95  # odd, so that powers have inverses


def stretches(buf: np.ndarray, ends: np.ndarray, size: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of window starts with the same anchor hash: (text, low, high, hash, content hash, anchors).

    buf holds texts one after another, ``ends`` their ends. A run [low, high] spans the
    bytes [low, high + size); its content hash is that of those bytes. low and high count
    from the text's start. ``anchors`` is how many places the run's anchors stand at.
    Each ``level`` has a hash of its own, and so other anchors.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(buf) < size:
        return none
    h = _grams(buf)
    if level:
        h = mix64(h + _U(level) * _U(0x9E3779B97F4A7C15))
    key = (h >> _U(_BITS) << _U(_BITS)) | np.arange(len(h), dtype=np.uint64)
    at = (_least(key, size - GRAM + 1) & _U((1 << _BITS) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(at)]
    p = np.flatnonzero(np.arange(len(at)) + size <= ends[text])
    if not len(p):
        return none
    at, text = at[p], text[p]
    kind = h[at]
    new = np.ones(len(p), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (text[1:] != text[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    moved = np.ones(len(p), np.int64)
    moved[1:] = at[1:] != at[:-1]
    moved[first] = 1
    low, high = p[first], p[last]
    # content by a polynomial of scattered eight-byte words: a difference of sums, shifted to the front
    words = np.zeros(len(buf) - 7, np.uint64)
    raw = buf.tobytes()
    for j in range(8):
        part = np.frombuffer(raw, "<u8", count=(len(buf) - j) // 8, offset=j)
        words[j::8] = part[: len(words[j::8])]
    power = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix64(words) * power[:-1], out=sums[1:])
    content = mix64((sums[high + size - 7] - sums[low]) * _inverses(len(words) + 1)[low] + (high - low).astype(np.uint64))
    t = text[first]
    return t, low - starts[t], high - starts[t], kind[first].view(np.int64), content.view(np.int64), np.add.reduceat(moved, first)


_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    if base not in _TABLES or len(_TABLES[base]) < n:
        x = np.full(max(n, _PIECE + 1_000), base, np.uint64)
        x[0] = 1
        _TABLES[base] = np.multiply.accumulate(x)
    return _TABLES[base][:n]


def _powers(n: int) -> np.ndarray:
    return _table(_R, n)


def _inverses(n: int) -> np.ndarray:
    return _table(pow(_R, -1, 1 << 64), n)


def _pieces(sizes: np.ndarray, size: int):
    """Lists of (text, from, to): short texts together, long ones in overlapping parts, each window in one part."""
    held, room = [], 0
    for i, n in enumerate(sizes.tolist()):
        for a in range(0, max(1, n - size + 1), _PIECE):
            b = min(n, a + _PIECE + size - 1)
            if room + b - a > _PIECE + size and held:
                yield held
                held, room = [], 0
            held.append((i, a, b))
            room += b - a
    if held:
        yield held


_STRETCH = "doc bigint, row bigint, low bigint, high bigint, anchor bigint, content bigint, anchors bigint"


def _raw(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def _find(size: int, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _STRETCH.split(", ")]
    for b in batches:
        texts = [_raw(t) for t in b["text"].to_pylist()]
        doc, row = b["doc"].to_numpy(), b["row"].to_numpy()
        for piece in _pieces(np.array([len(t) for t in texts], np.int64), size):
            buf = np.frombuffer(b"".join(texts[i][a:z] for i, a, z in piece), np.uint8)
            ends = np.cumsum([z - a for _, a, z in piece])
            k, low, high, anchor, content, anchors = stretches(buf, ends, size, level)
            who = np.array([i for i, _, _ in piece])[k] if len(k) else k
            shift = np.array([a for _, a, _ in piece])[k] if len(k) else k
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[who], row[who], low + shift, high + shift, anchor, content, anchors)], names)


def _fetch(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches asked for."""
    names = ["anchor", "content", "hot", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for b in batches:
        out: list[list] = [[] for _ in names]
        held = 0
        for t, asked in zip(b["text"].to_pylist(), b["asked"].to_pylist()):
            raw = _raw(t)
            for x in asked:
                piece = raw[x["low"] : x["high"] + size]
                for c, v in zip(out, (x["anchor"], x["content"], x["hot"], piece)):
                    c.append(v)
                held += len(piece)
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                out, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def repeated_suffixes(s: np.ndarray, size: int) -> np.ndarray:
    """Where strings of ``size`` numbers start that start elsewhere in s too.

    s holds texts, each ended by 0 and otherwise positive. The open boundaries between
    neighbouring suffixes are closed level by level: an interval of suffixes with a common
    prefix of some length, extended backward by each number before it, gives intervals one
    longer, and one that ends at an open boundary closes it and goes on. What is open when
    the length reaches ``size`` stays open: those neighbours share at least ``size``.
    """
    n = len(s)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    sa = suffix_array(s, size).astype(np.int32)
    bwt = s[sa - 1]
    order = np.argsort(bwt.astype(np.uint16 if s.max() < 65_536 else np.int64), kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)  # the row of the suffix one longer
    step[order] = np.arange(n, dtype=np.int32)
    same = np.zeros(n + 1, bool)
    same[1:n] = bwt[order][1:] == bwt[order][:-1]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # the next and last row with the same number before it
    after[order[:-1]] = np.where(same[1:n], order[1:], n)
    before[order[1:]] = np.where(same[1:n], order[:-1], -1)
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    # strings of length one: each number, and each text's end on its own
    heads = s[sa]
    edge = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]) | (heads[1:] == 0), [True]]))
    low, high = edge[:-1], edge[1:]
    fresh = open_[high]
    open_[high] = False
    low, high = low[fresh], high[fresh]
    for _ in range(size - 1):
        if not len(low):
            break
        width = high - low
        rows = spread(low, width)
        lo, hi = np.repeat(low, width), np.repeat(high, width)
        real = bwt[rows] != 0
        firsts = np.sort(step[rows[real & (before[rows] < lo)]])
        lasts = np.sort(step[rows[real & (after[rows] >= hi)]])
        fresh = open_[lasts + 1]
        low, high = firsts[fresh], lasts[fresh] + 1
        open_[high] = False
    out[sa] = open_[:-1] | open_[1:]
    return out


def _runs(flags: np.ndarray) -> np.ndarray:
    """[start, end) of the runs of True, a row each."""
    f = np.concatenate([[False], flags, [False]])
    return np.flatnonzero(f[1:] != f[:-1]).reshape(-1, 2)


def _expand(size: int, table: pa.Table) -> pa.Table:
    """Of the stretches of a block: window starts that repeat, as ranges from each stretch's start."""
    raw = [np.frombuffer(x, np.uint8) for x in table["bytes"].to_pylist()]
    parts = []
    for x in raw:
        parts += [x.astype(np.int32) + 1, np.zeros(1, np.int32)]
    s = np.concatenate(parts)
    found = repeated_suffixes(s, size)
    ends = np.cumsum([len(x) + 1 for x in raw])
    rows = [[(int(a), int(b)) for a, b in _runs(found[e - 1 - len(x) : e - 1])] for x, e in zip(raw, ends)]
    ranges = pa.array([[{"a": a, "b": b} for a, b in r] for r in rows], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
    return pa.table({"anchor": table["anchor"].combine_chunks(), "content": table["content"].combine_chunks(), "ranges": ranges})


def _windows(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the stretches by a 128-bit content hash, for anchors too frequent for one transform."""
    names = ["anchor", "content", "at", "w1", "w2"]
    for b in batches:
        for anchor, content, x in zip(b["anchor"].to_pylist(), b["content"].to_pylist(), b["bytes"].to_pylist()):
            buf = np.frombuffer(x, np.uint8)
            h = _grams(buf)
            m = len(buf) - size + 1
            ws = []
            for salt in (0x2545F4914F6CDD1D, 0x632BE59BD9B4E019):
                w = np.zeros(m, np.uint64)
                for k in [*range(0, size - GRAM, GRAM), size - GRAM]:
                    w = mix64(w * _U(0x9E3779B97F4A7C15) + (h[k : k + m] ^ _U(salt)))
                ws.append(pa.array(w.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, anchor)), pa.array(np.full(m, content)), pa.array(np.arange(m)), *ws], names)


_MERGED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(size: int, ranges_name: str, names: tuple[str, str], as_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the removed spans, and the bytes left; or puts those, as text, into the column text."""
    for b in batches:
        spans, kept = [], []
        for t, ranges in zip(b["text"].to_pylist(), b[ranges_name].to_pylist()):
            merged: list[list[int]] = []
            for x in sorted((x["a"], x["b"] + size - 1) for x in ranges or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            spans.append([{"start": a, "end": z} for a, z in merged])
            if as_text and not merged:
                kept.append(t)
                continue
            raw, out, at = (t or "").encode("utf-8", "surrogatepass"), [], 0
            for a, z in merged:
                out.append(raw[at:a])
                at = z
            out.append(raw[at:])
            left = b"".join(out)
            # a cut may leave some bytes of a character; as text those are dropped
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
        held = [c for c in b.schema.names if c != ranges_name]
        if as_text:
            yield pa.RecordBatch.from_arrays([*(pa.array(kept, pa.string()) if c == "text" else b[c] for c in held), pa.array(spans, _MERGED)], [*held, names[0]])
        else:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in held), pa.array(spans, _MERGED), pa.array(kept, pa.binary())], [*held, *names])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text; equal rows share a key and, being equal, a result."""
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), "_row": F.xxhash64(F.col("doc_id").cast("bigint"), text_or_empty())})


def repeated_ranges(docs: DataFrame, *, size: int = 200, hot_bytes: int = HOT, levels: int = LEVELS) -> DataFrame:
    """(doc, row, ranges): starts [a, b) of windows that start elsewhere too, by document key.

    An anchor whose distinct stretches hold more than ``hot_bytes`` would make a transform
    too large for a task. Its stretches are then taken for texts themselves and dealt anew
    by anchors of another hash, up to ``levels`` times; equal windows still meet, as all of
    a window's bytes decide its anchors. What is too large even then has next to the same
    bytes everywhere; its windows are counted exactly by content, with sums combined before
    the shuffle.
    """
    d = _keyed(docs.select("doc_id", "text")).select(F.col("_doc").alias("doc"), F.col("_row").alias("row"), text_or_empty().alias("text"))
    return _repeats(d, size, hot_bytes, levels, 0)


def _repeats(d: DataFrame, size: int, hot_bytes: int, levels: int, level: int) -> DataFrame:
    """(doc, row, ranges) of texts (doc, row, text); text is a string or binary."""
    spark = d.sparkSession
    found = cut(map_arrow(d.where(F.octet_length("text") >= size), partial(_find, size, level), _STRETCH), "stretches")
    again = cut(found.groupBy("anchor").agg(F.sum("anchors").alias("n"), F.count(F.lit(1)).alias("weight")).where("n > 1").select("anchor", "weight"), "anchors")
    some = cut(spread_join(found, again, ["anchor"], "weight", found.count()), "again")
    free_shuffles(spark)
    release(found, again)
    # equal stretches merge before any text moves; their windows repeat by that alone
    kinds = cut(some.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "row", "low", "high")).alias("at")), "kinds")
    length = F.col("at.high") - F.col("at.low") + size
    single = kinds.groupBy("anchor").agg((F.min("n") == 1).alias("single"), F.sum(length).alias("bytes"), F.count(F.lit(1)).alias("weight")).where("single").select("anchor", "bytes", "weight")
    asked = cut(spread_join(kinds, single, ["anchor"], "weight", kinds.count()).select("anchor", "content", (F.col("bytes") > hot_bytes).alias("hot"), "at.*"), "asked")
    free_shuffles(spark)
    total = asked.agg(F.coalesce(F.sum(F.col("high") - F.col("low") + size), F.lit(0))).first()[0]
    per_doc = asked.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "content", "hot", "low", "high")).alias("asked"))
    bytes_of = map_arrow(d.join(per_doc, ["doc", "row"]).select("text", "asked"), partial(_fetch, size), "anchor bigint, content bigint, hot boolean, bytes binary")
    # rows that are equal bring the same bytes
    texts = cut(bytes_of, "texts")
    free_shuffles(spark)
    blocks = max(1, total // BLOCK)
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block")

    def expand(table: pa.Table) -> pa.Table:
        return _expand(size, table)

    usual = texts.where("not hot").drop("hot").dropDuplicates(["anchor", "content"])
    ranges = usual.withColumn("block", block).groupBy("block").applyInArrow(expand, "anchor bigint, content bigint, ranges array<struct<a:bigint,b:bigint>>")
    if not asked.where("hot").isEmpty():
        large = texts.where("hot").drop("hot").dropDuplicates(["anchor", "content"])
        if level < levels:
            large = cut(large.select(F.col("anchor").alias("doc"), F.col("content").alias("row"), F.col("bytes").alias("text")), "large")
            ranges = ranges.unionByName(_repeats(large, size, hot_bytes, levels, level + 1).toDF("anchor", "content", "ranges"))
        else:
            w = map_arrow(large, partial(_windows, size), "anchor bigint, content bigint, at bigint, w1 bigint, w2 bigint")
            twice = w.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w1", "w2")
            one = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b")))
            ranges = ranges.unionByName(w.join(twice, ["w1", "w2"]).select("anchor", "content", one.alias("ranges")))
    ranges = cut(ranges.where(F.size("ranges") > 0), "ranges")
    whole = kinds.where("n > 1").select("anchor", "content", "n", F.lit(True).alias("whole"))
    alone = spread_join(some, whole, ["anchor", "content"], "n", some.count(), "left")
    copies = alone.where("whole").select("doc", "row", F.col("low").alias("a"), (F.col("high") + 1).alias("b"))
    parts = alone.where("whole is null").select("doc", "row", "anchor", "content", "low").join(ranges, ["anchor", "content"]).select("doc", "row", "low", F.explode("ranges").alias("x"))
    parts = parts.select("doc", "row", (F.col("low") + F.col("x.a")).alias("a"), (F.col("low") + F.col("x.b")).alias("b"))
    out = cut(copies.union(parts).groupBy("doc", "row").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "spans")
    free_shuffles(spark)
    release(some, kinds, asked, texts, ranges)
    return out


def without_repeats(docs: DataFrame, *, size: int = 200, hot_bytes: int = HOT, levels: int = LEVELS, as_text: bool = False) -> tuple[DataFrame, str, str]:
    """docs and two more columns, and their names: the byte runs removed and the bytes left.

    With ``as_text`` the bytes left stand in the column text instead, as text.

    Every byte goes that lies in a string of ``size`` bytes which also starts anywhere else
    in the table, the same document included; strings are judged on the input. Null text is
    empty. Texts shorter than ``size`` stay whole. Rows that are equal are copies of each
    other, so all of each that is long enough goes. An empty table gives no rows.
    """
    r = repeated_ranges(docs, size=size, hot_bytes=hot_bytes, levels=levels)
    doc, row, ranges, spans, kept = (fresh(docs, c) for c in ("_doc", "_row", "_ranges", "_spans", "_kept"))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), row: F.xxhash64(F.col("doc_id").cast("bigint"), text_or_empty())})
    d = keyed.join(r.toDF(doc, row, ranges), [doc, row], "left").select(*docs.columns, ranges)
    more = [StructField(spans, d.select(F.array(F.struct(F.lit(1).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("end")))).schema[0].dataType)]
    more += [] if as_text else [StructField(kept, BinaryType())]
    return map_arrow(d, partial(_remove, size, ranges, (spans, kept), as_text), StructType([*docs.schema.fields, *more])), spans, kept


def removal(docs: DataFrame, *, size: int = 200, hot_bytes: int = HOT, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, n_bytes, spans, kept (the bytes left)."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out, spans, kept = without_repeats(d, size=size, hot_bytes=hot_bytes, levels=levels)
    return out.select("doc_id", F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"), F.col(spans).alias("spans"), F.col(kept).alias("kept"))


def clean_texts(docs: DataFrame, *, size: int = 200) -> DataFrame:
    """docs, same columns, with the repeats cut from their texts; a document that loses everything goes.

    A character of which a cut leaves some bytes only is dropped.
    """
    out, spans, _ = without_repeats(docs, size=size, as_text=True)
    return out.where((F.size(spans) == 0) | (F.length(F.trim("text")) > 0)).drop(spans)


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
