"""Order statistics of whole columns without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.scratch import cut, fresh

#: Value ranges that a global ranking is split into.
RANGES = 64


def _edges(df: DataFrame, col: str) -> list:
    """Distinct approximate quantiles, RANGES at most; they only balance the work."""
    at = [i / RANGES for i in range(1, RANGES)]
    got = df.agg(F.percentile_approx(col, at, 10_000).alias("e")).first()["e"]
    return sorted(set(got or []))


def global_rank(df: DataFrame, value: str, key: str, name: str = "rn") -> DataFrame:
    """df with its 1-based place in the order of (value, key), nulls last; ``key`` must be unique.

    Rows fall into value ranges between approximate quantiles. Each is numbered on its own
    and shifted by the rows of the ranges before it, so the order is exact and no task holds
    the whole table. A value frequent enough to be a quantile has a range of its own, split
    further by key.
    """
    ve, ke = _edges(df, value), _edges(df, key)
    below = lambda c, es: sum(((F.col(c) > F.lit(e)).cast("int") for e in es), F.lit(0))
    tied = F.coalesce(F.col(value).isin(ve), F.lit(False)) if ve else F.lit(False)
    part = F.when(F.col(value).isNull(), 2 * len(ve) + 1).otherwise(2 * below(value, ve) + tied.cast("int"))
    v, k, n, shift, own = (fresh(df, c) for c in ("_v", "_k", "_n", "_before", "_own"))
    d = df.withColumn(v, part).withColumn(k, F.when(tied | F.col(value).isNull(), below(key, ke)).otherwise(0))
    sizes = d.groupBy(v, k).agg(F.count(F.lit(1)).alias(n))  # a few hundred rows at most
    before = sizes.select(v, k, (F.sum(n).over(Window.orderBy(v, k)) - F.col(n)).alias(shift))
    place = F.row_number().over(Window.partitionBy(v, k).orderBy(F.col(value).asc_nulls_last(), key))
    return d.withColumn(own, place).join(F.broadcast(before), [v, k]).withColumn(name, (F.col(shift) + F.col(own)).cast("bigint")).drop(v, k, own, shift)


def long_ranks(df: DataFrame, features: list[str], key: str, keep: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """(f, rn, keep...) for each non-null value of the features: its place within feature number f; and rows per feature.

    The same ranking as global_rank() for many columns at once: one pass for the
    quantiles, one shuffle for the ranks.
    """
    at = [i / RANGES for i in range(1, RANGES)]
    row = df.agg(F.percentile_approx(key, at, 10_000).alias("key"), *(x for i, c in enumerate(features) for x in (F.count(c).alias(f"n{i}"), F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"e{i}")))).first()
    table = lambda edges, kind: F.array(*(F.lit(e).cast(kind) for e in sorted(set(edges or [])))).cast(f"array<{kind}>")
    edges = F.element_at(F.array(*(table(row[f"e{i}"], "double") for i in range(len(features)))), F.col("f") + 1)
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features))))
    d = df.select(F.col(key).alias("_key"), *keep, cells.alias("c")).select("_key", *keep, "c.f", "c.v").where("v is not null")
    tied = F.array_contains(edges, F.col("v"))
    below = lambda es, x: F.size(F.filter(es, lambda e: e < x))
    d = d.withColumn("_v", 2 * below(edges, F.col("v")) + tied.cast("int")).withColumn("_k", F.when(F.col("_v") % 2 == 1, below(table(row["key"], dict(df.dtypes)[key]), F.col("_key"))).otherwise(0))
    sizes = d.groupBy("f", "_v", "_k").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("f", "_v", "_k", (F.sum("_n").over(Window.partitionBy("f").orderBy("_v", "_k")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("f", "_v", "_k").orderBy("v", "_key"))
    d = d.withColumn("_own", own).join(F.broadcast(before), ["f", "_v", "_k"])
    return d.select("f", (F.col("_before") + F.col("_own")).cast("bigint").alias("rn"), *keep), {c: row[f"n{i}"] for i, c in enumerate(features)}


def with_next(df: DataFrame, order: list[str], cols: dict[str, str]) -> DataFrame:
    """df with values of the next row in the whole order, nulls last: ``cols`` maps a column to its new name; null at the end.

    Rows are sorted in ranges, and each range is looked over on its own; only the last row
    of a range needs the first one of the next, and there are as many of those as ranges.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    part, first_, n, next_ = (fresh(df, c) for c in ("_range", "_first", "_n", "_next"))
    d = cut(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    w = Window.partitionBy(part).orderBy(*keys)
    first = d.select(part, F.struct(*cols).alias(first_), F.row_number().over(w).alias(n)).where(F.col(n) == 1)
    after = first.select((F.lag(part).over(Window.orderBy(part))).alias(part), first_).where(F.col(part).isNotNull())
    d = d.withColumn(next_, F.lead(F.struct(*cols)).over(w)).join(F.broadcast(after), part, "left")
    following = F.coalesce(next_, first_)
    return d.select(*df.columns, *(following[c].alias(new) for c, new in cols.items()))


def quantile_bucket(rn: Column, n: Column, q: int | Column) -> Column:
    """Bucket 1..q of place rn among n, by the edges 1 + (j/q)(n-1) of a quantile cut over ranks.

    j/q is a step times j, made a percentage and back: the roundings of the usual library,
    which decide on which side of an edge a whole rank falls.
    """
    if isinstance(q, int):
        q = F.lit(q)
    step = F.lit(1.0) / q
    js = F.sequence(F.lit(1), F.greatest(q.cast("int") - 1, F.lit(1)))
    edge = F.aggregate(js, F.lit(1), lambda a, j: a + ((j <= q - 1) & (rn > 1 + (j * step) * 100.0 / 100.0 * (n - 1))).cast("int"))
    return edge


def exact_medians(df: DataFrame, cols: list[str], small: int = 2_000_000, bins: int = 4096) -> dict[str, float | None]:
    """The interpolated median of each column, nulls and NaN left out.

    Up to ``small`` rows the built-in aggregate serves. Beyond, its state would hold every
    distinct value in one task, so the middles are narrowed instead, those of all columns in
    the same passes: counts by value range, then by range within the one that holds the
    middle. The driver never has more than ``bins`` sums a column.
    """
    numbers = [F.when(~F.isnan(x), x) for x in (F.col(c).cast("double") for c in cols)]
    stats = df.agg(*(x for i, v in enumerate(numbers) for x in (F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")))).first()
    sizes = [stats[f"n{i}"] for i in range(len(cols))]
    if max(sizes, default=0) <= small:
        row = df.agg(*(F.median(v).alias(f"m{i}") for i, v in enumerate(numbers))).first()
        return dict(zip(cols, row))
    found: dict[int, float | None] = {i: None for i, n in enumerate(sizes) if not n}
    # (lowest value, highest value, rows below) of the range that holds a column's middle rows
    open_ranges = {i: (stats[f"lo{i}"], stats[f"hi{i}"], 0) for i, n in enumerate(sizes) if n}
    while open_ranges:
        cells = F.array(*(F.struct(F.lit(i).alias("i"), numbers[i].alias("x"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for i, (lo, hi, _) in open_ranges.items()))
        d = df.select(F.explode(cells).alias("c")).select("c.*").where("x BETWEEN lo AND hi")
        # halves first, so that the width of the widest range is still a number
        share = F.try_divide(F.col("x") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
        sums: dict[int, list] = {i: [] for i in open_ranges}
        for r in d.groupBy("i", bin_.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            sums[r.i].append((r.b, r.c, r.lo, r.hi))
        for i, (_, _, below) in list(open_ranges.items()):
            low, high = (sizes[i] - 1) // 2, sizes[i] // 2
            holding: list = []
            for _, c, lo, hi in sorted(sums[i]):
                if below <= high and below + c > low:
                    holding.append((lo, hi, below))
                below += c
            if len(holding) == 2 or holding[0][0] == holding[0][1]:  # the middle lies between two ranges, or in one of a single value
                found[i] = (holding[0][1] + holding[-1][0]) / 2
                del open_ranges[i]
            else:
                open_ranges[i] = holding[0]
    return {c: found[i] for i, c in enumerate(cols)}
