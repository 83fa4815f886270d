"""The index in cells, incremental features and SQL table functions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import cells, rates, scorecard
from lakeloom.plans import sql_functions
from lakeloom.plans.adapters import frame
from lakeloom.streaming import incremental


def vectors(spark, m, extra="x"):
    return spark.createDataFrame([(i, [float(x) for x in v], extra, 0) for i, v in enumerate(m)], "id bigint, v array<double>, cell string, cosine int")


def nearest(m, q, k):
    unit = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
    s = unit @ (q / (np.sqrt(q @ q) or 1.0))
    order = np.lexsort((np.arange(len(m)), -np.round(s, 12)))[:k]
    return [(int(i), round(float(s[i]), 9)) for i in order]


def test_cells_that_cannot_answer_are_not_read(spark, tmp_path):
    r = np.random.default_rng(1)
    m = r.normal(size=(30, 16))[r.integers(0, 30, 2000)] + r.normal(size=(2000, 16)) * 0.05
    m[500:900] = m[500]  # a fifth of all rows is one vector
    m[7] = 0.0
    cells.build_cells(vectors(spark, m), "id", "v", f"{tmp_path}/i", cells=32)
    index = cells.load_cells(spark, f"{tmp_path}/i")
    assert index.sizes.sum() == 2000
    shares = []
    for q in (m[3], m[500] * 9, r.normal(size=16), m[7]):
        got, share = index.top_k([float(x) for x in q], 5)
        assert [(x.id, round(x.score, 9)) for x in got.collect()] == nearest(m, q, 5)
        shares.append(share)
    assert shares[0] < 0.3 and shares[1] < 0.5  # of the vectors; what is near to nothing may need all
    got, _ = index.top_k([float(x) for x in m[3]], 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell_" in plan or "PartitionFilters: [cell_" in plan
    everything, share = index.top_k([1.0] * 16, 5000)
    assert everything.count() == 2000 and share == 1.0
    assert index.top_k([1.0] * 16, 0)[0].count() == 0
    with pytest.raises(ValueError, match="15 numbers"):
        index.top_k([1.0] * 15, 3)


def test_poor_input_of_cells(spark, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        cells.build_cells(vectors(spark, np.zeros((0, 2))), "id", "v", f"{tmp_path}/e")
    d = spark.createDataFrame([(1, "[1, 0]"), (None, "[1, 1]"), (2, None), (3, "[0, 2]")], "id int, v string")
    cells.build_cells(d, "id", "v", f"{tmp_path}/t")
    assert [tuple(x) for x in cells.load_cells(spark, f"{tmp_path}/t").top_k([0.0, 5.0], 9)[0].collect()] == [(3, 1.0), (1, 0.0)]
    with pytest.raises(ValueError, match="1 to 2 numbers"):
        cells.build_cells(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, v array<double>"), "id", "v", f"{tmp_path}/x")


TX = "transaction_id bigint, customer_id bigint, purchase_datetime timestamp, quantity double, amount double, channel string"


def transactions(spark, ids):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 7 if i % 11 else None, start + dt.timedelta(hours=(i * 37) % 5000), float(i % 4) if i % 5 else None, float(i % 13) if i % 3 else None, "abc"[i % 3] if i % 8 else None) for i in ids]
    return spark.createDataFrame(rows, TX)


def close(a, b):
    key = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()), key=repr)
    return key(a) == key(b)


def test_features_of_increments(spark, tmp_path):
    """A stream read in several runs, one of which is delivered again after a failure, gives the features of one full run."""
    source = f"{tmp_path}/in"
    t = incremental.feature_table(spark, f"file://{tmp_path}/t", transactions(spark, []).schema, buckets=4)
    seen = []
    for part in (range(0, 90), range(90, 100), range(100, 300)):
        seen += part
        transactions(spark, part).write.mode("append").parquet(source)
        q = incremental.follow(spark.readStream.schema(transactions(spark, []).schema).parquet(source), t, f"file://{tmp_path}/c")
        q.awaitTermination(120)
        want = scorecard.features_with_label(transactions(spark, seen).where("customer_id IS NOT NULL"))
        assert close(incremental.current_features(t), want)
    before = t.version()
    for batch in (0, max(before.batches.values())):
        incremental.add_batch(t, transactions(spark, range(50)), "transactions", batch)
    assert t.version().number == before.number
    incremental.add_batch(t, transactions(spark, range(300, 310)), "another source", 0)
    assert close(incremental.current_features(t), scorecard.features_with_label(transactions(spark, range(310)).where("customer_id IS NOT NULL")))


def test_a_batch_that_failed_is_counted_once(spark, tmp_path, monkeypatch):
    source, schema = f"{tmp_path}/in", transactions(spark, []).schema
    t = incremental.feature_table(spark, f"file://{tmp_path}/t", schema, buckets=4)
    transactions(spark, range(60)).write.parquet(source)
    run = lambda: incremental.follow(spark.readStream.schema(schema).parquet(source), t, f"file://{tmp_path}/c")
    real = incremental.add_batch

    def fails_after(*a):
        real(*a)
        raise OSError("lost after the rows were merged")

    monkeypatch.setattr(incremental, "add_batch", fails_after)
    with pytest.raises(Exception, match="lost after"):
        run().awaitTermination(120)
    monkeypatch.setattr(incremental, "add_batch", real)
    run().awaitTermination(120)
    assert close(incremental.current_features(t), scorecard.features_with_label(transactions(spark, range(60)).where("customer_id IS NOT NULL")))


def test_functions_in_sql_equal_the_operators(spark, sf_dir):
    fx = frame(spark, sf_dir, "rates_fx").withColumns({c: F.col(c).cast("double") for c in ("buy_rate", "sell_rate")})
    saving = frame(spark, sf_dir, "rates_saving").withColumn("actual_rate", F.col("actual_rate").cast("double"))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key"), "embedding")
    assert sql_functions.register_functions(spark, fx, saving, e) == ["exchange_rate", "savings_rate", "nearest"]
    rows = lambda d: sorted(map(repr, map(tuple, d.collect())))
    until = dt.datetime(2024, 2, 1)
    assert rows(spark.sql("SELECT * FROM exchange_rate('USD', 'AUD')")) == rows(rates.exchange_rates(fx, ["USD", "AUD"]))
    assert rows(spark.sql("SELECT * FROM exchange_rate('USD', 'USD', 'CA1', TIMESTAMP '2024-02-01 00:00:00')")) == rows(rates.exchange_rates(fx, ["USD"], "CA1", until))
    assert rows(spark.sql("SELECT * FROM savings_rate()")) == rows(rates.savings_rates(saving))
    assert rows(spark.sql("SELECT * FROM savings_rate(array('524', 'TDE'), terms => array('6M', '1Y'), currency => 'VND')")) == rows(rates.savings_rates(saving, ["524", "TDE"], [], ["6M", "1Y"], ["VND"]))
    assert spark.sql("SELECT * FROM nearest(array(1D, 2D), 3)").count() == 0  # no vector of that length
    assert [r.key for r in spark.sql("SELECT * FROM nearest((SELECT transform(embedding, x -> double(x)) FROM {e} WHERE key = 3), 1)", e=e).collect()] == [3]


def test_conditions_of_functions_reach_the_scan(spark, sf_dir, tmp_path):
    frame(spark, sf_dir, "rates_fx").withColumns({c: F.col(c).cast("double") for c in ("buy_rate", "sell_rate")}).write.parquet(f"{tmp_path}/fx")
    sql_functions.register_functions(spark, spark.read.parquet(f"{tmp_path}/fx"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    d = spark.sql("SELECT ccy FROM exchange_rate('USD', 'EUR') WHERE rate_type = 'CA1'")
    pushed = d._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("ReadSchema")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "In(ccy, [EUR,USD])" in pushed or "In(ccy, [USD,EUR])" in pushed
    assert "EqualTo(rate_type,CA1)" in pushed
