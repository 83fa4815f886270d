"""Hard negatives: rows of another label that score nearly as high with an anchor as its positives.

All rows go into cover trees, blocks of one cell of a coarse net each, written to the shared
folder. Tasks take anchors against all blocks, the most promising first: they find an anchor's
positives, then what lies in each positive's window of scores. Blocks, nodes and leaves whose
bounds lie outside are skipped, the rest is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import cover_tree
from lakeloom.llm.common import cut, map_arrow, release, scratch
from lakeloom.llm.cover_tree import NONE, Best
from lakeloom.sources.stores import store

#: Vectors of a block and of a leaf, about; rows that the coarse net is fitted on; its largest size.
BLOCK, LEAF, SAMPLE, CELLS = 4_096, 64, 4_096, 1_024
#: Anchors searched for at a time, the fewest for a task, and the most tasks.
TOGETHER, A_TASK, TASKS = 256, 64, 10_000


def _whole(scale: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with whole-number vectors as bytes; rows that take no part are left out."""
    names = ["vec_id", "label", "anchor", "dim", "square", "v"]
    for b in batches:
        v = b["v"]
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        ends = v.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        with np.errstate(all="ignore"):
            x = np.floor(scale * x)
            fine = np.abs(x) <= 1 << 31
        x = np.where(fine, x, 0.0)
        before = lambda a: np.append(0, np.cumsum(a))
        sums = before(x * x)
        if sums[-1] < 2**52:
            square = np.diff(sums[ends])
        else:  # differences of such sums would not be exact
            square = np.array([(x[lo:hi] ** 2).sum() for lo, hi in zip(ends, ends[1:])])
        ok = pa.array((np.diff(before(~fine)[ends]) == 0) & (square <= 2**62))
        raw = x.astype("<i8")
        data = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        out = [b["vec_id"], b["label"], b["anchor"], pa.array(np.diff(ends).astype(np.int32)), pa.array(square), data]
        yield pa.RecordBatch.from_arrays(out, names).filter(ok)


def _matrix(v: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_pylist()), "<i8").reshape(len(v), -1)


def _net(sample: np.ndarray, k: int) -> np.ndarray:
    """k of the points, each the farthest from those before."""
    out, far = [0], np.full(len(sample), np.inf)
    while len(out) < min(k, len(sample)):
        far = np.minimum(far, 1.0 - sample @ sample[out[-1]])
        if far.max() <= 1e-12:
            break
        out.append(int(far.argmax()))
    return sample[out]


def _cell(net: np.ndarray, top: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest of the net's points, and a number that deals a cell's rows."""
    n = 0
    for b in batches:
        if b.num_rows:
            near = np.argmax(cover_tree.augmented(_matrix(b["v"]), top) @ net.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(np.arange(n, n + b.num_rows))], [*b.schema.names, "cell", "deal"])
            n += b.num_rows


_SUMMARY = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("angle", pa.float64()), ("center", pa.binary())])


def _grow(path: str, top: float, leaf: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tree for each (cell, part) of the task's sorted rows, in one file of this attempt; yields their summaries."""
    from pyspark import TaskContext

    task = TaskContext.get()
    name = f"{path}/trees-{task.partitionId():06d}-{task.taskAttemptId()}"
    fs, at = store(name)
    out, offset, held, key = None, 0, [], None

    def finish() -> dict:
        nonlocal out, offset
        t = pa.Table.from_batches(held)
        tree = cover_tree.build(*(t[c].to_numpy() for c in ("vec_id", "label")), _matrix(t["v"].combine_chunks()), top, leaf)
        raw = cover_tree.packed(tree)
        if out is None:
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            out = fs.open_output_stream(at, buffer_size=1 << 20)
        out.write(raw)
        offset += len(raw)
        return {"file": name, "offset": offset - len(raw), "size": len(raw), "n": len(tree.ids), "angle": float(tree.angle[0]), "center": tree.center[0].astype("<i8").tobytes()}

    for b in batches:
        keys = b["cell"].to_numpy().astype(np.int64) << 32 | b["part"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                if key is not None and keys[lo] != key:
                    yield pa.RecordBatch.from_pylist([finish()], _SUMMARY)
                    held.clear()
                key = keys[lo]
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.RecordBatch.from_pylist([finish()], _SUMMARY)
    if out is not None:
        out.close()


_FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64()), ("verified", pa.int64())])


def _through(blocks: dict, best: Best, anchors: np.ndarray, labels: np.ndarray, own: np.ndarray, top: float) -> int:
    """Offer every block that may serve a query, the most promising first; returns the vectors verified."""
    least, most = cover_tree.bounds(anchors, blocks["center"], blocks["angle"], top)
    seen, used = 0, np.flatnonzero(best.wanted(least, most).any(0))
    for k in used[np.argsort(-most[:, used].max(0), kind="stable")].tolist():
        queries = np.flatnonzero(best.wanted(least[:, k : k + 1], most[:, k : k + 1])[:, 0])
        if len(queries):
            fs, at = store(blocks["file"][k])
            with fs.open_input_file(at) as f:
                tree = cover_tree.unpacked(f.read_at(blocks["size"][k], blocks["offset"][k]))
            seen += cover_tree.search(tree, best, queries, anchors, labels, own, top)
    return seen


def _mine(index: str, top: float, k: int, positives: int, window: tuple[int, int], together: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = None
    for b in batches:
        for lo in range(0, b.num_rows, together):
            part = b.slice(lo, together)
            if blocks is None:
                fs, at = store(index)
                t = pq.read_table(at, filesystem=fs)
                blocks = {c: t[c].to_pylist() for c in ("file", "offset", "size")} | {"angle": t["angle"].to_numpy(), "center": _matrix(t["center"].combine_chunks())}
            own, labels, anchors = part["vec_id"].to_numpy(), part["label"].to_numpy(), _matrix(part["v"])
            n = len(own)
            near = Best(np.arange(n), np.full(n, NONE), np.full(n, -NONE), positives, same=True)
            seen = _through(blocks, near, anchors, labels, own, top)
            hundreds, rest = np.divmod(near.score, 100)  # percent * score may not fit 64 bits
            low = window[0] * hundreds - (-window[0] * rest) // 100
            high = window[1] * hundreds + (window[1] * rest) // 100
            far = Best(near.query, low, high, k, same=False)
            seen += _through(blocks, far, anchors, labels, own, top)
            rank = np.arange(len(far.query)) - np.searchsorted(far.query, far.query) + 1
            anchor = near.query[far.query]
            verified = np.full(len(rank), seen / max(1, n)).astype(np.int64)
            cols = [own[anchor], near.id[far.query], rank.astype(np.int32), far.id, near.score[far.query], far.score, verified]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_FOUND)


def hard_negatives(rows: DataFrame, anchor: Column, scale: float = 1.0, k: int = 5, positives: int = 5, window: tuple[int, int] = (80, 100), block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """For every anchor and each of its positives, the first k rows of other labels in the positive's window.

    rows has vec_id, label and vector (an array of numbers); ``anchor`` is a condition on its
    columns. A component x becomes floor(scale * x); scores are inner products of those, whole
    numbers. Positives: the anchor's first rows of its own label, by score (highest first) and
    vec_id. Negatives: window[0] * positive <= 100 * score <= window[1] * positive, in the
    same order. All are taken if there are fewer. Returns anchor_id, positive_id, rank (from
    1), negative_id, positive_score, negative_score and verified (the vectors whose score was
    computed for the anchor's group, over the anchors of it).

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part;
    nor do those with a component beyond 2^31 or a squared norm beyond 2^62, whose scores might
    not fit 64 bits, nor vectors of another length than most have (the shortest of the most
    frequent). Rows that share a vec_id are rows of their own, but none is a positive of an
    anchor of that vec_id. Other columns are left out. No rows, no anchors or no positives:
    no result.
    """
    spark = rows.sparkSession
    d = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>").alias("v"))
    points = cut(map_arrow(d.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"), partial(_whole, scale), "vec_id bigint, label bigint, anchor boolean, dim int, square double, v binary"), "points")
    most = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square"), F.count_if("anchor").alias("anchors")).orderBy(F.desc("n"), "dim").first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, verified bigint"
    if most is None or not most.anchors or not most.dim:
        return spark.createDataFrame([], schema)
    used, top = points.where(F.col("dim") == most.dim), float(np.sqrt(most.square))
    sample = used.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).toArrow()["v"].combine_chunks()
    net = _net(cover_tree.augmented(_matrix(sample), top), max(1, min(CELLS, most.n // block)))
    celled = cut(map_arrow(used.drop("dim", "square"), partial(_cell, net, top), "vec_id bigint, label bigint, anchor boolean, v binary, cell int, deal bigint"), "cells")
    sizes = {r.cell: r.n for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # CELLS rows at most
    parts = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, -(-n // block))))[F.col("cell")]
    dealt = celled.select("vec_id", "label", "v", "cell", F.pmod(F.xxhash64("deal"), parts).cast("int").alias("part"))
    dealt = dealt.repartition(max(1, min(TASKS, most.n // (4 * block) + 1)), "cell", "part").sortWithinPartitions("cell", "part")
    index = cut(map_arrow(dealt, partial(_grow, scratch(spark, "trees"), top, leaf), "file string, offset bigint, size bigint, n bigint, angle double, center binary"), "blocks")
    asked = celled.where("anchor").select("vec_id", "label", "v").repartition(max(1, min(TASKS, most.anchors // A_TASK)))
    found = map_arrow(asked, partial(_mine, index._scratch, top, k, positives, window, TOGETHER), schema)
    release(points)
    return found
