"""Second-order boosting against a plain version, and its scoring as an expression."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import boosting, evaluate, training
from lakeloom.operators.boosting import Params, TreeModel, fit_trees


def plain_fit(x, y, edges, objective, p):
    """Predictions of trees grown row by row in recursion."""
    base = math.log(y.mean() / (1 - y.mean())) if objective == "logistic" else y.mean()
    margin = np.full(len(y), base)
    for _ in range(p.rounds):
        g, h = (1 / (1 + np.exp(-margin)) - y, np.exp(-margin) / (1 + np.exp(-margin)) ** 2) if objective == "logistic" else (margin - y, np.ones(len(y)))
        add = np.zeros(len(y))

        def grow(rows, depth):
            G, H = g[rows].sum(), h[rows].sum()
            best = (p.min_gain if p.min_gain > 1e-10 else 1e-10, None)
            if depth < p.depth:
                for f in range(x.shape[1]):
                    v = x[rows, f]
                    for side in (True, False):
                        for e in edges[f]:
                            left = np.where(np.isnan(v), not side, v < e)
                            a, b = g[rows][left].sum(), h[rows][left].sum()
                            if min(b, H - b) < p.min_weight:
                                continue
                            gain = (a * a / (b + p.l2) + (G - a) ** 2 / (H - b + p.l2) - G * G / (H + p.l2)) / 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, left)
            if best[1] is None:
                add[rows] = -G / (H + p.l2) * p.rate
            else:
                grow(rows[best[1]], depth + 1)
                grow(rows[~best[1]], depth + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + add
    return margin if objective == "squared" else 1 / (1 + np.exp(-margin))


def made(n, seed=1):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 6, n), r.exponential(size=n)]).astype(float)
    x[r.random((n, 3)) < 0.1] = np.nan
    z = np.nan_to_num(x[:, 0]) * 1.5 + (np.nan_to_num(x[:, 1], nan=5) > 3) - np.nan_to_num(x[:, 2]) * 0.5
    return x, (z + r.normal(size=n) > 0).astype(float), z + r.normal(size=n) * 0.1


def frame(spark, x, y):
    rows = [(i, *(None if math.isnan(v) and i % 2 else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, x0 double, b double, margin double, y double").repartition(3)


@pytest.mark.parametrize("objective", ["logistic", "squared"])
def test_equals_the_plain_version(spark, objective, monkeypatch):
    monkeypatch.setattr(boosting, "EVERY", 2)
    x, label, value = made(2000)
    y = label if objective == "logistic" else value
    p = Params(rounds=5, depth=3, rate=0.3, rows=1.0, columns=1.0, bins=20)
    d = frame(spark, x, y)
    edges = boosting.quantile_edges(d, ["x0", "b", "margin"], p.bins)
    assert [len(e) for e in edges] == [18, 5, 18] and all((np.diff(e) > 0).all() for e in edges)
    m = fit_trees(d, ["x0", "b", "margin"], "y", objective, p)
    got = [r.p for r in d.withColumn("p", m.prediction()).orderBy("id").collect()]
    assert np.abs(np.array(got) - plain_fit(x, y, edges, objective, p)).max() < 1e-6


def test_scoring_is_an_expression(spark, tmp_path):
    """Saved, loaded, and scored without a Python worker; equal to the walk in arrays."""
    x, y, _ = made(3000, 2)
    d = frame(spark, x, y)
    m = fit_trees(d, ["x0", "b", "margin"], "y", params=Params(rounds=6, depth=4))
    m.save(spark, f"file://{tmp_path}/m")
    loaded = TreeModel.load(spark, f"file://{tmp_path}/m")
    assert loaded == m
    d.write.parquet(f"{tmp_path}/d")
    s = spark.read.parquet(f"{tmp_path}/d").withColumn("p", loaded.prediction()).where("p > 0.5").select("id", "p")
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "id#" in plan.split("ReadSchema")[0]
    margin = np.full(len(x), m.base)
    for t in m.trees:
        margin += np.array(t.leaf)[boosting.walk(t, x, m.depth)]
    want = 1 / (1 + np.exp(-margin))
    got = {r.id: r.p for r in s.collect()}
    assert set(got) == set(np.flatnonzero(want > 0.5)) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert evaluate.auc(d.withColumn("p", m.prediction()).withColumn("y", F.col("y").cast("int")), "y", "p").first().auc > 0.85


def test_shares_and_poor_inputs(spark):
    ids = np.arange(100_000)
    kept = boosting.sampled(ids, 3, 0.9, 42)
    assert abs(kept.mean() - 0.9) < 0.01 and (kept != boosting.sampled(ids, 4, 0.9, 42)).any() and boosting.sampled(ids, 0, 1.0, 1).all()
    kind = "a double, y double"
    none = fit_trees(spark.createDataFrame([], kind), ["a"], "y")
    one = fit_trees(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (None, None)], kind), ["a"], "y")
    flat = fit_trees(spark.createDataFrame([(None, 1.0), (None, 3.0)], kind), ["a"], "y", "squared", Params(rounds=2))
    d = spark.createDataFrame([(1.0, None), (float("nan"), 0.0)], kind)
    assert [r.p for r in d.select(none.prediction().alias("p")).collect()] == [0.5, 0.5]
    assert [r.p > 0.999 for r in d.select(one.prediction().alias("p")).collect()] == [True, True]
    assert [r.p for r in d.select(flat.prediction().alias("p")).collect()] == [2.0, 2.0]
    with pytest.raises(ValueError):
        fit_trees(d, ["a"], "y", "other")


def test_training_flow_with_second_order_trees(spark):
    """On generated customers, with three components, in the neighbourhood of the published quality."""
    from lakeloom.sources.readers import synthetic_transactions

    s = training.train_scorecard(synthetic_transactions(spark, 8_000, 1_000, seed=42), components=3, second_order=Params(rounds=25))
    assert abs(s.metrics["boosted"]["auc"] - 0.9536) < 0.03
    assert isinstance(s.fitted["boosted"], TreeModel)


def test_levels_walk_few_trees_and_margins_are_the_same(spark, monkeypatch):
    d = spark.range(300).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("z"), (F.col("id") % 37 * 3 + F.col("id") % 11).cast("double").alias("y")).coalesce(1)
    walked, real = [], boosting.partial
    monkeypatch.setattr(boosting, "partial", lambda f, *a: (walked.append(len(a[0]["since"])) if f is boosting._sums else None, real(f, *a))[1])
    fit = lambda: boosting.fit_trees(d, ["x", "z"], "y", "squared", boosting.Params(rounds=7, depth=2)).to_json()
    often = fit()
    assert max(walked) < 4
    monkeypatch.setattr(boosting, "EVERY", 20)
    assert fit() == often
