"""A log of numbered entries that several writers share: an entry appears whole, and once."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class CommitLog:
    """Entries 1, 2, ... as JSON files in a folder; a writer claims the next number or learns that it is taken.

    An entry is written aside and then moved to its number, which fails if that is there: by
    a link on a local disk, by a rename elsewhere. The store must rename without replacing,
    at once, as HDFS and ABFS with a hierarchy do.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = self._at(self.path)
        self._fs = folder.getFileSystem(self._conf)
        self._fs.mkdirs(folder)
        self._local = self._fs.getScheme() == "file"

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _name(self, number: int) -> str:
        return f"{self.path}/{number:020d}.json"

    def last(self) -> int:
        """The highest number there is; 0 for an empty log."""
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)))
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._at(self._name(number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, entry: dict) -> bool:
        """Write entry under the number; False, and nothing changed, if another writer has it."""
        aside, to = self._at(f"{self.path}/.{uuid.uuid4().hex}"), self._at(self._name(number))
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        try:
            if not self._local:
                return not self._fs.exists(to) and self._fs.rename(aside, to)
            os.link(*(unquote(urlparse(p.toUri().toString()).path) for p in (aside, to)))
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(aside, False)

    def add(self, entry: dict, tries: int = 1_000) -> int:
        """Write entry under the next free number and return that."""
        for _ in range(tries):
            if self.put(number := self.last() + 1, entry):
                return number
        raise RuntimeError(f"{self.path}: no free number in {tries} tries")
