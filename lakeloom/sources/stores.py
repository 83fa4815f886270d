"""Files in any store, as tasks open them without a JVM, and mirrors between two of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.scratch import cut, release
from lakeloom.session import ship

#: Hadoop's names of stores, and the ones that Arrow's file systems have for them.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}
#: Bytes copied at a time, and the most tasks that list or copy.
_PIECE, TASKS = 8 << 20, 1_000


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it.

    Arrow has local files, HDFS and the large object stores; credentials come from where
    those clients look for them. Another scheme raises.
    """
    scheme, sep, rest = path.partition(":")
    if not sep or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), re.sub(r"^//[^/]*", "", rest) or "/"
    return pafs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + sep + rest)


def _info(f: pafs.FileInfo, base: str) -> dict:
    return {"key": f.path[len(base) :].lstrip("/"), "size": f.size, "changed": f.mtime_ns or 0}


_FILE = pa.schema([("key", pa.string()), ("size", pa.int64()), ("changed", pa.int64())])


def _list(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, base = store(root)
    for b in batches:
        for prefix in b["prefix"].to_pylist():
            found = [_info(f, base) for f in fs.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/{prefix}", recursive=True)) if f.type == pafs.FileType.File]
            yield pa.RecordBatch.from_pylist(found, _FILE)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """key, size, changed of all files under a root, hidden ones too; none if it is not there.

    The driver looks at the first level only; tasks list what is below each folder of it.
    """
    fs, base = store(root)
    top = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    files = spark.createDataFrame([tuple(_info(f, base).values()) for f in top if f.type == pafs.FileType.File], "key string, size bigint, changed bigint")
    folders = [(f.base_name,) for f in top if f.type == pafs.FileType.Directory]
    if not folders:
        return files
    ship(spark)
    below = spark.createDataFrame(folders, "prefix string").repartition(min(TASKS, len(folders)))
    return files.unionByName(below.mapInArrow(partial(_list, root), "key string, size bigint, changed bigint"))


_DONE = pa.schema([("key", pa.string()), ("action", pa.string()), ("size", pa.int64())])


def _apply(source: str, target: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copy or delete; a file appears under its name when it is whole."""
    from pyspark import TaskContext

    (src, a), (dst, b_root) = store(source), store(target)
    for b in batches:
        for key, action, size in zip(b["key"].to_pylist(), b["action"].to_pylist(), b["size"].to_pylist()):
            to = f"{b_root.rstrip('/')}/{key}"
            if action == "copied":
                folder, _, name = to.rpartition("/")
                aside = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
                dst.create_dir(folder, recursive=True)
                try:
                    with src.open_input_stream(f"{a.rstrip('/')}/{key}", compression=None) as x, dst.open_output_stream(aside, compression=None) as y:
                        while piece := x.read(_PIECE):
                            y.write(piece)
                    dst.move(aside, to)
                except BaseException:
                    if dst.get_file_info(aside).type == pafs.FileType.File:
                        dst.delete_file(aside)
                    raise
            elif action == "deleted" and dst.get_file_info(to).type == pafs.FileType.File:
                dst.delete_file(to)
            yield pa.RecordBatch.from_pylist([{"key": key, "action": action, "size": size}], _DONE)


def mirror_files(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Make target's files those of source: copy what is missing, of another size or older there; delete what source lacks.

    Both roots are seen by all tasks. Returns the manifest: key, action (copied, deleted or
    kept) and size. Tasks list, copy and delete; the driver holds counts. A run that fails
    half-way leaves whole files only, and the next one does the rest.
    """
    ship(spark)
    have, there = list_files(spark, source).alias("a"), list_files(spark, target).alias("b")
    both = have.join(there, F.col("a.key") == F.col("b.key"), "full_outer")
    stale = F.col("b.key").isNull() | (F.col("a.size") != F.col("b.size")) | (F.col("b.changed") < F.col("a.changed"))
    action = F.when(F.col("a.key").isNull(), "deleted").when(stale, "copied").otherwise("kept")
    plan = cut(both.select(F.coalesce("a.key", "b.key").alias("key"), action.alias("action"), F.coalesce("a.size", "b.size").alias("size")), "mirror")
    work = plan.where("action <> 'kept'")
    parts = max(1, min(TASKS, work.count()))
    done = cut(work.repartition(parts).mapInArrow(partial(_apply, source, target), "key string, action string, size bigint").unionByName(plan.where("action = 'kept'")), "mirrored")
    release(plan)
    return done
