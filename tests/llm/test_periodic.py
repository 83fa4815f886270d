"""Periodic runs and the grammar's extensions against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import periodic, queries
from lakeloom.llm.recompression import common_extension, grammar, mirrored
from tests.llm.brute import WORD


def plain_runs(w, times=4, least=6):
    """By definition: stretches with smallest period q that no neighbour extends."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q):
                out.setdefault((i, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def made(r):
    """Words with runs of several periods, nested and side by side."""
    w = []
    for _ in range(r.randrange(6)):
        part = [r.choice("abc") for _ in range(r.randrange(1, 7))]
        w += part * r.randrange(1, 7) + part[: r.randrange(len(part))]
        if r.random() < 0.3:
            w += w[-r.randrange(1, 40) :] * r.randrange(1, 5)
    return w


@given(st.lists(st.integers(0, 2), max_size=60), st.randoms())
@settings(max_examples=150, deadline=None)
def test_extensions(body, r):
    w = np.array([7, *body, 8])
    levels = grammar(w)
    back = mirrored(levels)
    pairs = [(a, b) for a in range(len(w)) for b in range(len(w)) if a != b]
    a, b = (np.array(x) for x in zip(*pairs))
    def far(v, x, y):
        n = 0
        while x + n < len(v) and y + n < len(v) and v[x + n] == v[y + n]:
            n += 1
        return n
    assert common_extension(levels, a, b).tolist() == [far(w, x, y) for x, y in pairs]
    assert common_extension(back, a, b).tolist() == [far(w[::-1], x, y) for x, y in pairs]


def test_extensions_of_long_periods():
    r = np.random.default_rng(3)
    for body in (np.zeros(100_000, int), np.tile(r.integers(0, 5, 7), 10_000), np.tile(r.integers(0, 50_000, 30_000), 3), np.tile(np.repeat([1, 2], 500), 60)):
        w = np.concatenate([[10**6], body, [10**6 + 1]])
        levels = grammar(w)
        assert len(levels) < 150
        for d in (1, 7, 1000, 30_000):
            a = np.array([1, 2, 500])
            want = [len(x) if (x := w[s + d : -1]).size and (x == w[s : s + len(x)]).all() else int(np.argmin(np.append(w[s : s + len(x)] == x, False))) for s in a]
            assert common_extension(levels, a, a + d).tolist() == want


def test_runs_of_made_words():
    r = random.Random(8)
    for times, least in ((4, 6), (3, 1), (2, 2), (5, 30)):
        seqs = [made(r) for _ in range(200)] + [[], ["a"], ["a"] * 5, ["a"] * 6, list("ab") * 4, list("ab") * 3]
        got = periodic.runs_of([np.array([ord(x) - 97 for x in s], np.int64) for s in seqs], times, least)
        want = [(k, *x) for k, s in enumerate(seqs) for x in plain_runs(s, times, least)]
        assert list(zip(*(c.tolist() for c in got))) == want
    assert [len(c) for c in periodic.runs_of([])] == [0] * 4


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.queries()["op11_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted((plain_row(*d) for d in docs), key=repr)
    assert rows(got) == want
    assert sum(w[1] > 0 for w in want) > 5


def test_pieces_of_a_batch(monkeypatch):
    """Few bytes and words at a time give what one piece gives."""
    r = random.Random(6)
    texts = [None, "", *(" ".join(made(r)) for _ in range(200))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    whole = pa.Table.from_batches(periodic._run(4, 6, [batch]))
    monkeypatch.setattr(periodic, "BYTES", 300)
    monkeypatch.setattr(periodic, "WORDS", 50)
    pieces = list(periodic._run(4, 6, [batch.slice(0, 90), batch.slice(90)]))
    assert len(pieces) > 20 and pa.Table.from_batches(pieces).to_pydict() == whole.to_pydict()


def test_awkward_texts(spark, tmp_path):
    r = random.Random(4)
    texts = [None, "", " \t\n ", "one", "a " * 6, "a " * 5, "\x0b".join("ab" * 40), " x x   é é é é é é é ", "long " + "w1 w2 w3 " * 500 + " end", *(" ".join(made(r)) for _ in range(150))]
    docs = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, "a b " * 9), (None, None), (-4, "c " * 99)]
    df = spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in docs], "doc_id bigint, text string, h string, w string, runs string, n string, place string, longest string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.queries()["op11_periodic_runs"](spark, str(tmp_path)))
    assert got == sorted((plain_row(*d) for d in docs), key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0
