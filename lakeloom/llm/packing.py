"""Packing by optimal length buckets.

A dynamic programme over the global length histogram picks the bucket boundaries that
waste least padding; batches of a token budget then form inside each bucket.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, fresh
from lakeloom.llm.token_counts import with_lengths

#: Where lengths share cells (see histogram), those up to this still have cells of their own.
_OWN = 2048


@dataclass(frozen=True)
class Packing:
    """What plan() found: boundaries ascending, and the padding they cost."""

    boundaries: list[int]
    padding: int
    rows: int


def _cell(n: Column, bits: int) -> Column:
    # a logarithm rounded the wrong way only moves a cell's edge; each cell still is a range of lengths
    scale = F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - bits, F.lit(0)).cast("int")
    return F.when(n <= _OWN, n).otherwise(_OWN + scale.cast("bigint") * (1 << (bits + 2)) + F.floor(n / F.pow(F.lit(2.0), scale)))


def histogram(lengths: DataFrame, bits: int | None = None) -> DataFrame:
    """Cells (top, n, total) of a frame with a bigint column n_tokens.

    One cell per distinct length, exact; there are no more of them than the longest
    document has tokens. With ``bits`` lengths over 2,048 that agree in so many leading bits
    share a cell: then there are under 2^bits cells a doubling, and boundaries are the best
    among the cells' longest lengths.
    """
    cell = F.col("n_tokens") if bits is None else _cell(F.col("n_tokens"), bits)
    return lengths.groupBy(cell.alias("cell")).agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total")).drop("cell")


def plan(top: Sequence[int], n: Sequence[int], total: Sequence[int], buckets: int) -> Packing:
    """The best boundaries among the cells' tops: least sum of boundary - length, in whole numbers.

    With C the rows so far, closing a bucket at cell j costs top[j] * (C[j] - C[i]) less the
    tokens in it: a line in top[j] for each start i, slopes falling, so the least line is
    found with a queue in linear time per bucket. Numbers have no bound, so sums of any
    size are exact.
    """
    cells = sorted(zip(*([int(x) for x in v] for v in (top, n, total))))
    m = len(cells)
    if not m:
        return Packing([], 0, 0)
    top, c, s = [t for t, _, _ in cells], [0], [0]
    for _, k, t in cells:
        c.append(c[-1] + k)
        s.append(s[-1] + t)
    best: list[int | None] = [0] + [None] * m
    back, final, stop = [], None, 0
    for k in range(min(buckets, m)):
        nxt, frm, q = [None] * (m + 1), array("q", [0] * (m + 1)), deque()
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                a, b = -c[i], best[i] + s[i]
                while len(q) > 1 and (b - q[-2][1]) * (q[-2][0] - q[-1][0]) <= (q[-1][1] - q[-2][1]) * (q[-2][0] - a):
                    q.pop()
                q.append((a, b, i))
            x = top[j - 1]
            while len(q) > 1 and q[1][0] * x + q[1][1] <= q[0][0] * x + q[0][1]:
                q.popleft()
            if q:
                nxt[j] = q[0][0] * x + q[0][1] + x * c[j] - s[j]
                frm[j] = q[0][2]
        back.append(frm)
        if final is None or nxt[m] < final:
            final, stop = nxt[m], k
        best = nxt
    cuts, j = [], m
    for k in range(stop, -1, -1):
        cuts.append(top[j - 1])
        j = back[k][j]
    return Packing(cuts[::-1], final, c[-1])


COLUMNS = ("n_tokens", "bucket", "boundary", "batch_id", "slot", "batch_rows", "padding")


def pack(docs: DataFrame, length: Column | None = None, *, carry: Sequence[str] = ("doc_id",), buckets: int = 16, budget: int = 65_536, bits: int | None = None, shard_rows: int = 20_000) -> tuple[DataFrame, Packing]:
    """One row per document: the columns ``carry``, n_tokens, bucket, boundary, batch_id, slot, batch_rows, padding.

    The length is the number of token ids of the whole text (see token_counts) and one end
    id, or the column ``length`` where it is given, 0 where that is null. A batch holds rows of one bucket, padded
    to its boundary, with rows * boundary within the budget; a document longer than the
    budget is a batch of its own. Only a bucket's last batch may be short. Rows are
    numbered inside hash shards of about shard_rows and shifted by the rows of earlier
    shards, so no bucket ever sits in one task, nor do rows that repeat.

    Null text has one token, the end id. Repeated rows are packed each. An empty table
    gives no rows. Columns carried keep their names; where they clash with packing's own,
    those get an underscore more.
    """
    names = [fresh(docs.select(*carry), c) for c in COLUMNS]
    tokens, row = names[0], fresh(docs, "_place")
    d = with_lengths(docs, tokens, carry, end=1) if length is None else docs.select(*carry, F.coalesce(length.cast("bigint"), F.lit(0)).alias(tokens))
    w = cut(d.withColumn(row, F.monotonically_increasing_id()), "lengths")
    h = histogram(w.select(F.col(tokens).alias("n_tokens")), bits).toPandas()
    found = plan(h["top"], h["n"], h["total"], buckets)
    bounds = found.boundaries or [1]
    shards = max(1, -(-found.rows // shard_rows))
    mine = F.struct(*(F.col(c) for c in w.columns if c != row)).alias("d")
    bucket = sum(((F.col(tokens) > b).cast("int") for b in bounds[:-1]), F.lit(0))
    d = w.select(mine, bucket.alias("bucket"), F.xxhash64(row).alias("h"))
    d = d.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    sizes = d.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = sizes.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("bucket")).alias("all"))
    d = d.withColumn("row", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h")) - 1).join(earlier, ["bucket", "shard"])
    boundary = F.element_at(F.array(*(F.lit(b).cast("bigint") for b in bounds)), F.col("bucket") + 1)
    d = d.select("d", "bucket", boundary.alias("boundary"), (F.col("before") + F.col("row")).alias("at"), "all")
    d = d.withColumn("room", F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.col("boundary")).cast("bigint")))
    number = F.floor(F.col("at") / F.col("room")).cast("bigint")
    own = (F.col("bucket"), F.col("boundary"), number, F.col("at") % F.col("room"), F.least(F.col("room"), F.col("all") - number * F.col("room")), F.col("boundary") - F.col("d").getField(tokens))
    return d.select("d.*", *(c.alias(n) for c, n in zip(own, names[1:]))), found


def batches(packed: DataFrame, carried: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per batch of pack(): bucket, boundary, batch_id, rows - an array, by slot, of what was carried.

    A batch is bounded by the token budget, or one document.
    """
    row = F.struct("slot", *carried, "n_tokens", "padding")
    return packed.groupBy("bucket", "boundary", "batch_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
