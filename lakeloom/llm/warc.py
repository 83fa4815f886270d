"""WARC archives: written with one gzip member a record, read back from any byte range.

A reading task gets a range of a file. It scans it for gzip's magic, takes a place for a
member's start only if what follows inflates to a WARC header, and owns the records that start
inside its range, wherever they end. From the first record on it goes from member to member.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, map_arrow, release, scratch, spread_join
from lakeloom.sources.stores import store

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file that are read at a time; and the most that a record's header may have.
_CHUNK, _HEADER = 1 << 18, 1 << 20
#: The profile that names a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of one reading task's range, and the most tasks of a read.
SPLIT, TASKS = 16 << 20, 10_000


# --- writing


def _starts_record(data: bytes) -> bool:
    """Do these bytes begin a gzip member that holds a WARC record?"""
    if len(data) < 18 or data[:3] != MAGIC or data[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(data, 7) == b"WARC/1."
    except zlib.error:
        return False


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member. No other member can be found inside it, whatever the record holds.

    Deflate keeps what it cannot compress as it is, so an archive in a payload might be taken
    for records; its magic is parted by a flush then.
    """
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    at = out.find(MAGIC, 1)
    while at >= 0 and not _starts_record(out[at : at + _CHUNK]):
        at = out.find(MAGIC, at + 1)
    if at < 0:
        return out
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    parts = re.split(rb"(?<=\x1f)(?=\x8b\x08)", record)
    return b"".join(z.compress(p) + z.flush(zlib.Z_SYNC_FLUSH) for p in parts) + z.flush()


def _uri(url: str) -> str:
    """A URL that keeps to its header line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, record_id: str, date: str, block: bytes, content_type: str, **more: str | None) -> bytes:
    """A WARC/1.1 record; ``more`` are further header lines, null ones are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _page_urn(page_id: int | None, digest: str, place: str = "") -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest[:16]}{place}"


_MANIFEST = pa.schema([("file", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])


def _write(path: str, date: str, shared: int, file_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's archives, each of about file_bytes at most, under names of this attempt."""
    from pyspark import TaskContext

    task, part, row, out, done = TaskContext.get(), 0, 0, None, []
    stem = f"{path}/pages-{task.partitionId():06d}-{task.taskAttemptId()}"
    fs, at = store(stem)
    for b in batches:
        for page_id, url, digest, n, payload, first, revisit in zip(*(b[c].to_pylist() for c in ("page_id", "url", "digest", "n", "payload", "first", "revisit"))):
            if out is None:
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(f"{at}-{part:04d}.warc.gz", compression=None, buffer_size=1 << 20)
                written = out.write(member(record("warcinfo", f"urn:archive:{task.partitionId()}:{part}", date, b"software: lakeloom\r\n", "application/warc-fields")))
                records = 0
            more = {"WARC_Target_URI": None if url is None else _uri(url), "WARC_Payload_Digest": f"sha256:{digest}"}
            place = "" if n >= shared and not revisit else f":{task.partitionId()}.{row}"
            if revisit:
                more |= {"WARC_Profile": PROFILE, "WARC_Refers_To": f"<{_page_urn(first, digest)}>"}
            block = _http(n) + (b"" if revisit else payload)
            written += out.write(member(record("revisit" if revisit else "response", _page_urn(page_id, digest, place), date, block, "application/http;msgtype=response", **more)))
            records, row = records + 1, row + 1
            if written >= file_bytes:
                out.close()
                done.append({"file": f"{stem}-{part:04d}.warc.gz", "n_bytes": written, "n_records": records})
                out, part = None, part + 1
    if out is not None:
        out.close()
        done.append({"file": f"{stem}-{part:04d}.warc.gz", "n_bytes": written, "n_records": records})
    if done:
        yield pa.RecordBatch.from_pylist(done, _MANIFEST)


def write_archives(pages: DataFrame, path: str, shared: int = 100, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> DataFrame:
    """Write one record a row of pages (page_id, url, html); payload the html in UTF-8.

    Returns the manifest: file, n_bytes, n_records. Files bear the name of a task's attempt
    and the manifest names the complete ones, so a task that runs again spoils nothing.
    Among rows with equal payloads of at least ``shared`` bytes the smallest page_id gets a
    response record, the others revisits that refer to it and hold no payload. Null html is
    an empty payload, a null url gives no target. A null page_id comes after all others; rows
    that repeat the smallest page_id (or have none, if none has) are responses too, under the
    same record id, as a revisit names another page. Further columns are left out. ``date`` stands in every
    record, so that a rerun writes the same bytes.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload")})
    groups = rows.where(F.col("n") >= shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = cut(groups.where("copies > 1"), "payloads")
    joined = spread_join(rows, firsts, ["digest"], "copies", pages.count(), how="left")
    joined = joined.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    joined = joined.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    manifest = cut(map_arrow(joined, partial(_write, path, date, shared, file_bytes), "file string, n_bytes bigint, n_records bigint"), "archives")
    release(firsts)
    return manifest


# --- reading

Read = Callable[[int, int], bytes]


class Inflated:
    """The bytes of the gzip member at ``start``, in pieces; ``end`` is the file offset after it."""

    def __init__(self, read: Read, start: int) -> None:
        self._read, self._at, self._z, self._held = read, start, zlib.decompressobj(31), b""
        self.end: int | None = None

    def _more(self) -> bool:
        while self.end is None:
            raw = self._z.unconsumed_tail or self._read(self._at, _CHUNK)
            if not self._z.unconsumed_tail:
                self._at += len(raw)
                if not raw:
                    raise ValueError("the gzip member is cut off")
            got = self._z.decompress(raw, 4 * _CHUNK)
            if self._z.eof:
                self.end = self._at - len(self._z.unused_data)
            if got:
                self._held += got
                return True
        return False

    def header(self) -> bytes | None:
        """What comes before the next empty line; None at the end."""
        looked = 0
        while (cut_at := self._held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(self._held) - 3)
            if looked > _HEADER:
                raise ValueError("a header without an end")
            if not self._more():
                if self._held.strip(b"\r\n"):
                    raise ValueError("a header without an end")
                return None
        out, self._held = self._held[:cut_at], self._held[cut_at + 4 :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self._held and not self._more():
                raise ValueError("a record is shorter than its header says")
            out, self._held = self._held[:n], self._held[n:]
            n -= len(out)
            yield out

    def skip(self, n: int) -> None:
        for _ in self.pieces(n):
            pass


def _fields(header: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with a blank continues the one before."""
    text = re.sub(r"\r\n[ \t]+", " ", header.decode("utf-8", "surrogateescape"))
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.split("\r\n")[1:])}


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>")


def _records(m: Inflated, with_payload: bool) -> Iterator[dict]:
    """The records of a member, one as a rule."""
    while (head := m.header()) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC header")
        f = _fields(head)
        left, http = int(f["content-length"]), {}
        if f.get("content-type", "").startswith("application/http") and left:
            before = m.header()
            if before is None or len(before) + 4 > left:
                raise ValueError("an HTTP header without an end")
            left, http = left - len(before) - 4, _fields(before)
        kind, digest, kept, n = f["warc-type"], hashlib.sha256(), [], left
        for p in m.pieces(left):
            digest.update(p)
            if with_payload:
                kept.append(p)
        m.skip(4)
        said = f.get("warc-payload-digest")
        found = digest.hexdigest()
        if kind == "revisit":  # the payload is elsewhere
            found, n = said and said.rpartition(":")[2], int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        elif kind == "response" and said and said.startswith("sha256:") and said[7:].lower() != found and len(said) == 71:
            raise ValueError("a payload differs from its digest")
        yield {"record_type": kind, "record_id": _bare(f.get("warc-record-id")), "refers_to": _bare(f.get("warc-refers-to")), "target_uri": f.get("warc-target-uri"), "date": f.get("warc-date"), "payload_bytes": n, "payload_digest": found, "payload": b"".join(kept) if with_payload and kind != "revisit" else None}


def first_member(read: Read, start: int, stop: int) -> int | None:
    """Where the first member with a record starts in [start, stop)."""
    at = start
    while at < stop:
        buf = read(at, min(_CHUNK, stop - at + 2))
        p = buf.find(MAGIC)
        while p >= 0 and at + p < stop:
            if _starts_record(buf[p:] if len(buf) - p >= 4_096 else read(at + p, 4_096)):
                return at + p
            p = buf.find(MAGIC, p + 1)
        if len(buf) < 3:
            return None
        at += len(buf) - 2
    return None


def records_in(read: Read, start: int, stop: int, with_payload: bool = True, strict: bool = True) -> Iterator[dict]:
    """The records whose members start in [start, stop) of a file that read(offset, n) gives.

    A damaged record raises; if not ``strict`` it is passed over, and the search goes on
    behind its start.
    """
    at = first_member(read, start, stop)
    while at is not None and at < stop:
        m, after = Inflated(read, at), at + 1
        try:
            for r in _records(m, with_payload):
                yield {"offset": at} | r
            after = m.end
        except (ValueError, KeyError, zlib.error) as e:
            if strict:
                raise ValueError(f"damaged record at {at}: {e}") from e
        at = after if _starts_record(read(after, 4_096)) else first_member(read, after, stop)


_KINDS = {"file": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "date": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
_SCHEMA = "file string, offset bigint, record_type string, record_id string, refers_to string, target_uri string, date string, payload_bytes bigint, payload_digest string, payload binary"


def _read(with_payload: bool, strict: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, start, stop in zip(b["file"].to_pylist(), b["start"].to_pylist(), b["stop"].to_pylist()):
            fs, at = store(file)
            with fs.open_input_file(at) as f:
                held, size = [], 0
                for r in records_in(lambda offset, n: f.read_at(n, offset), start, stop, with_payload, strict):
                    held.append({"file": file} | r)
                    size += len(r["payload"] or b"") + 500
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(_KINDS))
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, pa.schema(_KINDS))


def read_archives(manifest: DataFrame, with_payload: bool = True, strict: bool = True, split: int = SPLIT) -> DataFrame:
    """All records of gzipped archives (file, n_bytes), read by ranges of ``split`` bytes.

    file, offset of its member, record_type, record_id, refers_to (a revisit's), target_uri,
    date, payload_bytes, payload_digest (SHA-256, computed from what was read), payload. Of an
    HTTP record the payload is what follows the HTTP header. A revisit holds none: its size
    and digest are those its headers give, its payload is null, as it is without
    ``with_payload``. Digests are always computed, and compared with the header's where that
    is a SHA-256 in hex. Members may hold several records, which belong to the range in
    which the member starts. An empty manifest gives no rows.
    """
    ranges = manifest.where("n_bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1, F.lit(split).cast("bigint"))).alias("start"), "n_bytes")
    ranges = ranges.select("file", "start", F.least(F.col("start") + split, F.col("n_bytes")).alias("stop"))
    return map_arrow(ranges.repartition(max(1, min(TASKS, ranges.count()))), partial(_read, with_payload, strict), _SCHEMA)


def archive_path(spark: SparkSession) -> str:
    return scratch(spark, "warc")
