"""WARC archives against plain reading, over ranges of every size and archives inside payloads."""

import gzip
import hashlib
import random

import pytest

from lakeloom.llm import queries, warc
from tests.oracle import check

PAGES = "page_id bigint, url string, html string, digest string, payload string, first string, copies string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, *["x"] * 5) for i, u, h in rows], PAGES)


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    least = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            least[b] = min(x for x in (least.get(b), i) if x is not None) if (least.get(b), i) != (None, None) else None
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = least.get(b)
        other = first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if other else "response", first if other else None))
    return sorted(out, key=repr)


def result(spark, df, tmp_path, **how):
    written = warc.write_archives(df, f"file://{tmp_path}/w", **how)
    read = warc.read_archives(written, split=how.pop("split", 999)).where("record_type <> 'warcinfo'").collect()
    number = lambda urn: None if urn is None or urn.split(":")[2] == "" else int(urn.split(":")[2])
    return sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in read), key=repr), read


def test_query(spark, sf_dir):
    check(spark, sf_dir, queries.queries()["op13_warc"], queries.oracle_sql()["op13_warc"])


def test_awkward_pages(spark, tmp_path):
    r = random.Random(5)
    big = "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(400_000))
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://a/ b\r\nWARC-Type: x", "é" * 50), (4, "u", "é" * 50), (5, "u", "é" * 49), (6, "u", "é" * 49), (None, "u", "é" * 50), (None, "u", "é" * 50)]
    rows += [(7, "u", big), (3, "v", "é" * 50), (None, None, "z" * 200), (None, "x", "z" * 200), (-9, "u", "q\r\n\r\nWARC/1.1\r\n" * 20), (-3, "u", "q\r\n\r\nWARC/1.1\r\n" * 20)]
    rows += [(100 + i, f"http://h/{i}", "copy " * 300) for i in range(500)]
    r.shuffle(rows)
    got, read = result(spark, pages(spark, rows).repartition(4), tmp_path)
    assert got == plain(rows)
    by_id = {x.record_id: x for x in read}
    assert len(by_id) == len(rows) - 2  # only rows that repeat the first page of a payload share its record's id
    assert all(by_id[x.refers_to].record_type == "response" and by_id[x.refers_to].payload_digest == x.payload_digest for x in read if x.record_type == "revisit")
    assert next(bytes(x.payload).decode() for x in read if x.record_id.startswith("urn:page:7:")) == big
    assert next(x.target_uri for x in read if x.record_id.startswith("urn:page:3:") and x.target_uri != "v") == "http://a/%20b%0D%0AWARC-Type:%20x"


def test_files_turn_over(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * 40) for i in range(200)]
    df = pages(spark, rows).repartition(2)
    written = warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=3_000)
    assert written.count() > 10 and written.groupBy().sum("n_records").first()[0] == 200
    assert warc.read_archives(written, split=777).where("record_type = 'response'").count() == 200


def test_no_pages(spark, tmp_path):
    written = warc.write_archives(pages(spark, []), f"file://{tmp_path}/w")
    assert written.count() == 0 and warc.read_archives(written).count() == 0


def reader(data):
    return lambda at, n: data[at : at + n]


def http(payload):
    return b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def archive(payloads):
    out, starts = b"", []
    for i, p in enumerate(payloads):
        starts.append(len(out))
        out += warc.member(warc.record("response", f"urn:x:{i}", "d", http(p), "application/http", WARC_Payload_Digest=f"sha256:{hashlib.sha256(p).hexdigest()}"))
    return out, starts


def test_every_split_reads_each_record_once():
    r = random.Random(1)
    inner, _ = archive([r.randbytes(300) for _ in range(5)])
    payloads = [b"", b"a" * 5000, inner, r.randbytes(2000) + inner + r.randbytes(700_000) + inner, warc.MAGIC * 50, b"end"]
    data, starts = archive(payloads)
    assert data.count(warc.MAGIC) >= len(payloads)
    for size in (1, 7, 100, 1000, 65_536, len(data)):
        if size < 100 and len(data) > 100_000:
            edges = sorted({0, len(data), *(max(0, min(len(data), s + d)) for s in starts for d in range(-size * 3, size * 3 + 1, size))})
        else:
            edges = [*range(0, len(data), size), len(data)]
        got = [x for lo, hi in zip(edges, edges[1:]) for x in warc.records_in(reader(data), lo, hi)]
        assert [x["offset"] for x in got] == starts
        assert [x["payload"] for x in got] == payloads


def test_damage():
    data, starts = archive([b"one" * 50, b"two" * 50, b"three" * 50])
    bad = bytearray(data)
    bad[starts[2] - 6] ^= 1  # the checksum of the second member
    with pytest.raises(ValueError, match="damaged record"):
        list(warc.records_in(reader(bytes(bad)), 0, len(bad)))
    assert [x["record_id"] for x in warc.records_in(reader(bytes(bad)), 0, len(bad), strict=False) if x["payload"] != b"two" * 50] == ["urn:x:0", "urn:x:2"]
    with pytest.raises(ValueError, match="damaged record"):
        list(warc.records_in(reader(data[:-9]), 0, len(data)))
    wrong = warc.member(warc.record("response", "i", "d", http(b"abc"), "application/http", WARC_Payload_Digest=f"sha256:{'0' * 64}"))
    with pytest.raises(ValueError, match="differs"):
        list(warc.records_in(reader(wrong), 0, len(wrong)))


def test_archives_of_others():
    """A member of many records, header lines that go on, names in other case, a block that is no HTTP message."""
    text = b"WARC/1.0\r\nwarc-type: resource\r\nWarc-Record-Id: <urn:x:1>\r\nX-Long: a\r\n b\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    data = gzip.compress(text * 3) + gzip.compress(text)
    got = list(warc.records_in(reader(data), 0, len(data)))
    assert [(x["record_type"], x["payload"], x["record_id"]) for x in got] == [("resource", b"hello", "urn:x:1")] * 4
    assert list(warc.records_in(reader(data), 1, len(data))) == got[3:]
    assert list(warc.records_in(reader(b"no archive" * 100), 0, 1000)) == []
