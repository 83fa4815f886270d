"""Hard negatives against all pairs, and the cover tree's bounds and savings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import cover_tree, hard_negatives, queries
from tests.oracle import check

ROWS = "vec_id bigint, label int, vector array<double>, v string, anchor string, dim string, cell string, part string"


def plain(rows, is_anchor, scale, k=5, positives=5, window=(80, 100)):
    fit = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in fit:
        if is_anchor(i):
            scored = [(-sum(a * b for a, b in zip(v, u)), j, z) for j, z, u in fit]
            for s, j, _ in sorted(x for x in scored if x[2] == y and x[1] != i)[:positives]:
                inside = sorted(x for x in scored if x[2] != y and window[0] * -s <= 100 * -x[0] <= window[1] * -s)[:k]
                out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, y, v, *["x"] * 5) for i, y, v in rows], ROWS)


def found(df):
    return sorted(tuple(r)[:6] for r in df.collect())


def test_query(spark, sf_dir):
    q = queries.queries()["op12_hard_negatives"]
    assert q(spark, sf_dir).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    check(spark, sf_dir, q, queries.oracle_sql()["op12_hard_negatives"])


def test_awkward_rows(spark):
    r = np.random.default_rng(1)
    v = lambda *x: [float(y) for y in x]
    rows = [(i, int(r.integers(0, 3)), v(*r.integers(-4, 5, 3))) for i in range(400)]
    rows += [(1000 + i, int(i % 2), v(3, 1, 2)) for i in range(150)]  # one vector many times: ties by id
    rows += [(2, 1, v(1, 1, 1)), (2, 1, v(1, 1, 1)), (0, 0, v(0, 0, 0)), (10, 0, v(-3, 0, 0)), (500, None, v(1, 2, 3)), (510, 1, None), (520, 1, [1.0, None, 2.0]), (530, 1, [1.0, math.nan, 2.0]), (540, 0, [math.inf, 0.0, 0.0]), (None, 0, v(1, 1, 1)), (-20, 2, v(2, 2, 2))]
    d = frame(spark, rows).repartition(3)
    want = plain(rows, lambda i: i % 10 == 0, 1.5)
    assert len(want) > 500
    for block, leaf in ((4096, 64), (40, 4)):
        assert found(hard_negatives.hard_negatives(d, F.col("vec_id") % 10 == 0, 1.5, block=block, leaf=leaf)) == want
    want = plain(rows, lambda i: i % 50 == 0, 1.0, k=2, positives=3, window=(-50, 90))
    assert found(hard_negatives.hard_negatives(d, F.col("vec_id") % 50 == 0, k=2, positives=3, window=(-50, 90), block=100)) == want


def test_no_rows_and_no_anchors(spark):
    d = frame(spark, [])
    assert hard_negatives.hard_negatives(d, F.lit(True)).count() == 0
    d = frame(spark, [(1, 1, [1.0])])
    assert hard_negatives.hard_negatives(d, F.lit(None).cast("boolean")).count() == 0
    assert hard_negatives.hard_negatives(d, F.lit(True)).count() == 0


def test_large_numbers_are_exact(spark):
    big = float(1 << 29)
    rows = [(0, 0, [big, 1.0]), (1, 0, [big, 3.0]), (2, 1, [big, 2.0]), (3, 1, [big, 3.0]), (4, 1, [big, 4.0]), (5, 1, [1e300, 0.0]), (6, 1, [float(1 << 31), float(1 << 31)])]
    got = found(hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") == 0))
    assert got == [x for x in plain(rows[:5], lambda i: i == 0, 1.0)] and got[0][5] == (1 << 58) + 3
    mixed = [*rows[:5], (7, 1, [1.0]), (8, 1, [])]
    assert found(hard_negatives.hard_negatives(frame(spark, mixed), F.col("vec_id") == 0)) == got


def clustered(r, n, d=8, clusters=40):
    centers = r.normal(size=(clusters, d)) * 200
    return np.rint(centers[r.integers(0, clusters, n)] + r.normal(size=(n, d)) * 5).astype(np.int64)


def test_bounds_hold_and_leaves_are_skipped():
    r = np.random.default_rng(2)
    v = clustered(r, 3000)
    top = float(np.sqrt((v * v).sum(1).max()))
    tree = cover_tree.unpacked(cover_tree.packed(cover_tree.build(np.arange(3000), np.zeros(3000, np.int64), v, top, 32)))
    assert sorted(tree.ids.tolist()) == list(range(3000)) and (v[tree.ids] == tree.vectors).all()
    asked = np.concatenate([v[:50], np.zeros((1, 8), np.int64), r.integers(-300, 300, (50, 8))])
    least, most = cover_tree.bounds(asked, tree.center, tree.angle, top)
    true = cover_tree.scores(asked, tree.vectors)
    for k in range(len(tree.angle)):
        inside = true[:, tree.start[k] : tree.end[k]]
        assert (inside.max(1) <= most[:, k]).all() and (inside.min(1) >= least[:, k]).all()
    leaves = np.flatnonzero(tree.leaf)
    assert (tree.end - tree.start)[leaves].sum() == 3000
    labels = np.zeros(50, np.int64)
    seen = 0
    for q in range(50):
        best = cover_tree.Best(np.array([0]), np.array([cover_tree.NONE]), np.array([-cover_tree.NONE]), 5, True)
        seen += cover_tree.search(tree, best, np.array([0]), v[q : q + 1], labels[:1], np.array([q]), top)
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        assert best.id.tolist() == want
    assert seen < 50 * 3000 / 5  # under a fifth of all vectors is verified


def test_blocks_are_skipped(spark):
    r = np.random.default_rng(3)
    v = clustered(r, 4000)
    rows = [(i, int(i % 3), [float(x) for x in v[i]]) for i in range(4000)]
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 400 == 0, block=200, leaf=32)
    assert found(got) == plain(rows, lambda i: i % 400 == 0, 1.0)
    assert got.agg(F.max("verified")).first()[0] < 2 * 4000  # of twice 4,000, for positives and negatives
