"""A table with a key, in hash buckets of Parquet files, that takes merges while it is read.

A merge reads and rewrites only the buckets that hold its keys and then adds an entry to the
table's log, which names the files of every bucket. Readers see a whole version or the one
before; a merge that fails leaves files that no version names. Two merges at once both take
effect: the later one keeps what it wrote if the other touched other buckets, else it merges
again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators.relational import upsert
from lakeloom.scratch import cut, drop_path, release
from lakeloom.sources.commits import CommitLog

_BUCKET = "_bucket"
Combine = dict[str, Callable[[Column, Column], Column]]


@dataclass(frozen=True)
class Version:
    """What a log entry says: the folder of every bucket that has rows, the rows' type, and the last batch of every source."""

    number: int
    key: list[str]
    buckets: int
    schema: StructType
    folders: dict[int, str]
    batches: dict[str, int]


class KeyedTable:
    """Open a table at ``path``, or make an empty one if there is none and ``schema``, ``key`` and ``buckets`` are given.

    The number of buckets stays; a bucket should come to some 100 MB when the table is full.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str] | None = None, schema: StructType | None = None, buckets: int = 64) -> None:
        self._spark, self.path = spark, path.rstrip("/")
        self._log = CommitLog(spark, f"{self.path}/log")
        if not self._log.last():
            if schema is None or not key:
                raise ValueError(f"{path} is no table, and no schema and key are given")
            if _BUCKET in schema.names or not set(key) <= set(schema.names):
                raise ValueError(f"the columns need {key}, and none may be {_BUCKET}")
            self._commit(Version(1, list(key), buckets, schema, {}, {}))

    def _commit(self, v: Version) -> bool:
        return self._log.put(v.number, {"key": v.key, "buckets": v.buckets, "schema": v.schema.jsonValue(), "folders": {str(k): f for k, f in v.folders.items()}, "batches": v.batches})

    def version(self, number: int | None = None) -> Version:
        n = number or self._log.last()
        e = self._log.read(n)
        return Version(n, e["key"], e["buckets"], StructType.fromJson(e["schema"]), {int(k): f for k, f in e["folders"].items()}, e["batches"])

    def _rows(self, v: Version, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}" for k, f in sorted(v.folders.items()) if buckets is None or k in buckets]
        return self._spark.read.schema(v.schema).parquet(*paths) if paths else self._spark.createDataFrame([], v.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the last version, or of the one with this number."""
        return self._rows(self.version(number))

    def _bucket(self, v: Version) -> Column:
        return F.pmod(F.xxhash64(*v.key), F.lit(v.buckets)).cast("int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with these keys (a table of the key columns); only their buckets are read."""
        v = self.version()
        asked = keys.select(*(F.col(k).cast(v.schema[k].dataType).alias(k) for k in v.key)).distinct()
        touched = {r[0] for r in asked.select(self._bucket(v)).distinct().collect()}
        return self._rows(v, touched).join(asked, v.key, "left_semi")

    def _checked(self, rows: DataFrame, v: Version) -> DataFrame:
        """rows with the table's columns and types and their bucket, written once; null and repeated keys are an error."""
        d = cut(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in v.schema)).withColumn(_BUCKET, self._bucket(v)), "merge")
        bare = F.lit(False)
        for k in v.key:
            bare = bare | F.col(k).isNull()
        twice = d.groupBy(*v.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        if not d.where(bare).isEmpty() or not twice.isEmpty():
            release(d)
            raise ValueError("a key is null, or two of the rows have the same")
        return d

    def merge(self, rows: DataFrame, update: list[str] | None = None, source: str | None = None, batch: int | None = None, combine: Combine | None = None, tries: int = 20) -> int:
        """Insert rows with new keys; of rows with known keys take over the ``update`` columns only (all, if None).

        Columns of ``combine`` become what its functions make of the old and the new value.
        Returns the version that has them. Columns are taken by name. With ``source`` and
        ``batch``, a batch that is not newer than the source's last one changes nothing, so
        a stream may deliver it again. Null keys and keys that repeat in ``rows`` are an
        error. An empty merge makes a version only if it has a batch to note.
        """
        v = self.version()
        new = self._checked(rows, v)
        try:
            touched = {r[0] for r in new.select(_BUCKET).distinct().collect()}
            columns = [c for c in v.schema.names if c not in v.key] if update is None else update
            before, made = v, None
            for _ in range(tries):
                if source is not None and v.batches.get(source, -1) >= batch:
                    return v.number
                if not touched and source is None:
                    return v.number
                if made is None or any(v.folders.get(k) != before.folders.get(k) for k in touched):
                    made, before = self._written(v, new, touched, columns, combine), v
                batches = v.batches | ({source: batch} if source is not None else {})
                after = Version(v.number + 1, v.key, v.buckets, v.schema, v.folders | made, batches)
                if self._commit(after):
                    return after.number
                v = self.version()
            raise RuntimeError(f"{self.path}: other merges were faster {tries} times")
        finally:
            release(new)

    def _written(self, v: Version, new: DataFrame, touched: set[int], update: list[str], combine: Combine | None = None) -> dict[int, str]:
        """The touched buckets after the merge, as new files; their folders."""
        if not touched:
            return {}
        old = self._rows(v, touched)
        merged = upsert(old, new.drop(_BUCKET), v.key, update, combine).withColumn(_BUCKET, self._bucket(v))
        folder = f"data/{uuid.uuid4().hex}"
        merged.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        return {k: f"{folder}/{_BUCKET}={k}" for k in touched}

    def append_if_empty(self, rows: DataFrame) -> bool:
        """Fill a table that has no rows; False, and nothing changed, if it has some."""
        v = self.version()
        if v.folders:
            return False
        new = self._checked(rows, v)
        try:
            touched = {r[0] for r in new.select(_BUCKET).distinct().collect()}
            return self._commit(Version(v.number + 1, v.key, v.buckets, v.schema, self._written(v, new, touched, []), v.batches))
        finally:
            release(new)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data of versions before the last ``keep`` and of merges that failed; returns the folders deleted.

        Not beside a running merge, whose files no version names yet, nor a reader of an older version.
        """
        last = self._log.last()
        named = {f.rsplit("/", 1)[0] for n in range(max(1, last - keep + 1), last + 1) for f in self.version(n).folders.values()}
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        there = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        gone = [n for n in there if f"data/{n}" not in named]
        for n in gone:
            drop_path(self._spark, f"{self.path}/data/{n}")
        return len(gone)
