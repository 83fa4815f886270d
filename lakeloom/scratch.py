"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths that cut() wrote inside the innermost scope; each thread and context has its own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named and all runs on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/lakeloom/{what}-{uuid.uuid4().hex}"
    if (inside := _SCOPE.get()) is not None:
        inside.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path by Hadoop's file systems; one that is gone is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that was cut inside by this thread: write the results within it."""
    paths: list[str] = []
    outer = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for path in paths:
            drop_path(spark, path)


def cut(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them back.

    Later jobs do not recompute them, and a lost executor loses nothing. The table stays
    until release(), or the end of a scratch_scope() around it.
    """
    path = scratch(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what cut() wrote; the frames must not be read afterwards."""
    for df in frames:
        drop_path(df.sparkSession, df._scratch)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
