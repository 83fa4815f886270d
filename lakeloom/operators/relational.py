"""Keyed table operations: upsert, tail append, migration, differences, last values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.ranking import global_rank
from lakeloom.scratch import cut, fresh


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], update: list[str], combine: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Insert new keys; for known keys replace only the ``update`` columns, and make those of ``combine`` of both rows' values. Columns of old, in order."""
    keys = [key] if isinstance(key, str) else key
    mark_o, mark_n = fresh(old, "_old"), fresh(new, "_new")
    o, n = old.withColumn(mark_o, F.lit(True)).alias("o"), new.withColumn(mark_n, F.lit(True)).alias("n")
    had, hit = F.col(f"o.{mark_o}").isNotNull(), F.col(f"n.{mark_n}").isNotNull()

    def merged(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"o.{c}", f"n.{c}")
        if combine and c in combine:
            return F.when(had & hit, combine[c](F.col(f"o.{c}"), F.col(f"n.{c}"))).when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(hit if c in update else ~had, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    same = reduce(lambda a, b: a & b, (F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys))
    return o.join(n, same, "full_outer").select(*(merged(c).alias(c) for c in old.columns))


def tail_beyond(source: DataFrame, target_rows: int, order: str) -> DataFrame:
    """Rows of source after the first ``target_rows`` in the order of a unique column; nulls of strings become empty.

    The border is found by counts per range and then inside one range, not by a global sort.
    """
    rn = fresh(source, "_rn")
    return global_rank(source, order, order, rn).where(F.col(rn) > target_rows).drop(rn).fillna("")


def migrate_if_empty(spark: SparkSession, source: DataFrame, target: str, json_cols: list[str] = ()) -> bool:
    """Copy source into an existing table when that has no row; struct columns named are written as JSON text."""
    if not spark.table(target).isEmpty():
        return False
    d = source
    for c in json_cols:
        d = d.withColumn(c, F.to_json(c))
    d.select(*spark.table(target).columns).write.insertInto(target)
    return True


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(key).join(right.select(key), key, "left_anti").distinct()


def last_non_null(df: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """Per key the last value of each column that is not null, by seq."""
    return df.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols))


def first_unmet(cols: list[str]) -> Column:
    """The first column, in order, that is null; null when all are set."""
    out = F.lit(None).cast("string")
    for c in reversed(cols):
        out = F.when(F.col(c).isNull(), c).otherwise(out)
    return out


def all_set(cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def head_cap(df: DataFrame, over: int, keep: int, order: list[str]) -> DataFrame:
    """The first ``keep`` rows if there are more than ``over``, else all."""
    return df.orderBy(*order).limit(keep) if df.limit(over + 1).count() > over else df.orderBy(*order)


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each combination of keys, by order, nulls last; found by a minimum that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c)))))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns))


def last_turns(df: DataFrame, key: str, turn: str, n: int = 2) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(turn).desc())
    rn = fresh(df, "_rn")
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n).drop(rn)


def running_totals(df: DataFrame, key: str, seq: str, cols: dict[str, str]) -> DataFrame:
    """Cumulative sums per key in the order of seq: ``cols`` maps a column to its total's name. A key's seq must be unique.

    Rows are sorted in ranges of key and seq; sums run inside a key's part of a range and
    are shifted by those of its earlier ranges, so a key of any size is many tasks' work.
    """
    part, own_key, at = (fresh(df, c) for c in ("_range", "_key", "_at"))
    shift = {out: fresh(df, f"_{out}") for out in cols.values()}
    d = cut(df.repartitionByRange(F.col(key).asc_nulls_first(), F.col(seq).asc_nulls_first()).withColumn(part, F.spark_partition_id()), "ranges")
    own = Window.partitionBy(key, part).orderBy(F.col(seq).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = d.groupBy(F.col(key).alias(own_key), F.col(part).alias(at)).agg(*(F.sum(c).alias(shift[out]) for c, out in cols.items()))
    earlier = Window.partitionBy(own_key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(own_key, at, *(F.sum(x).over(earlier).alias(x) for x in shift.values()))
    d = d.withColumns({out: F.sum(c).over(own) for c, out in cols.items()})
    d = d.join(before, F.col(key).eqNullSafe(F.col(own_key)) & (F.col(part) == F.col(at)))
    # a total is null until a value that is not
    total = lambda out: F.when(F.col(out).isNull() & F.col(shift[out]).isNull(), None).otherwise(F.coalesce(out, F.lit(0)) + F.coalesce(shift[out], F.lit(0)))
    return d.select(*df.columns, *(total(out).alias(out) for out in cols.values()))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: the check that stands for a primary key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of child whose key no parent has: the check that stands for a foreign key."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti").where(F.col(fk).isNotNull())
