"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.scratch import cut, drop_path, release, scratch, scratch_scope, shared_dir  # noqa: F401  for the operators
from lakeloom.session import ship

#: Words between ASCII white space, as a Java and RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are out of use.

    The cleaner learns of them when the driver's JVM collects; a job of few, large steps
    may never make it do so by itself while its disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Of the C library, where it has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _lean(run: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    yield from run(batches)
    give_back()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, with this package on the workers' path even where it is not installed.

    The session decides how large batches are; see session.text_batches().
    """
    ship(df.sparkSession)
    return df.mapInArrow(partial(_lean, run), schema)


#: A key with more than one in so many of all rows is dealt to several tasks by spread_join().
SHARES = 200


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", large: bool = False) -> DataFrame:
    """left joined with right, which has one row a key and in ``weight`` how many of the ``total`` rows of left have it.

    The rows of a key that has over a share of all would meet in one task. They are dealt
    to as many parts as they hold shares, by a hash of the row, and right's row goes to each
    part. There are at most SHARES such keys, so their list is broadcast. ``how`` is inner
    or left. right is read twice and should be written, or cheap. ``large`` says that
    right's rows are too large to be broadcast however few they are.
    """
    share = max(1, total // SHARES)
    hot = F.broadcast(right.where(F.col(weight) > share).select(*keys, F.ceil(F.col(weight) / share).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, keys, "left").select(*left.columns, F.pmod(F.xxhash64(*left.columns), parts).cast("int").alias("_part"))
    copied = right.join(hot, keys, "left").select(*(c for c in right.columns if c != weight), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return dealt.join(copied.hint("merge") if large else copied, [*keys, "_part"], how).drop("_part")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (a public finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
