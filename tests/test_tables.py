"""Commit log, keyed table and model registry: concurrent writers, failures, whole versions."""

import threading
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import boosting, relational
from lakeloom.operators.registry import ModelRegistry
from lakeloom.scratch import cut, scratch_scope
from lakeloom.sources import keyed
from lakeloom.sources.commits import CommitLog
from lakeloom.sources.keyed import KeyedTable

SETTINGS = "id bigint, create_at bigint, update_at bigint, config string"


def settings(spark, ids, stamp):
    return spark.createDataFrame([(i, stamp, stamp, f"c{i}.{stamp}") for i in ids], SETTINGS)


def held(t, number=None):
    return sorted(map(tuple, t.read(number).collect()))


def test_scopes_of_two_threads(spark):
    kept, inside, done = {}, threading.Event(), threading.Event()

    def other():
        inside.wait(30)
        kept["df"] = cut(spark.range(5), "other")
        done.set()

    th = threading.Thread(target=other)
    th.start()
    with scratch_scope(spark):
        mine = cut(spark.range(3), "mine")
        inside.set()
        done.wait(60)
        with scratch_scope(spark):
            inner = cut(spark.range(2), "inner")
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            inner.collect()
        assert mine.count() == 3
    th.join()
    assert kept["df"].count() == 5  # another thread's table is left alone
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        mine.collect()


def test_commit_numbers_are_given_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/a log")
    assert log.last() == 0 and log.put(1, {"x": "é"}) and not log.put(1, {"x": 2}) and log.read(1) == {"x": "é"}
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: log.add({"k": k}), range(40)))
    assert sorted(got) == list(range(2, 42)) and [log.read(n)["k"] for n in got] == list(range(40))
    assert not [p for p in (tmp_path / "a log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_merge_equals_sql(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], settings(spark, [], 0).schema, buckets=8)
    assert held(t) == [] and t.append_if_empty(settings(spark, range(0, 60), 1)) and not t.append_if_empty(settings(spark, [1000], 9))
    new = settings(spark, range(40, 90), 2)
    n = t.merge(new, update=["update_at", "config"])
    old, new_rows = settings(spark, range(60), 1).toPandas(), new.toPandas()  # noqa: F841  read by the SQL
    want = duckdb.sql("SELECT coalesce(o.id, n.id), coalesce(o.create_at, n.create_at), coalesce(n.update_at, o.update_at), coalesce(n.config, o.config) FROM old o FULL JOIN new_rows n ON o.id = n.id ORDER BY 1").fetchall()
    assert held(t) == want and held(t, n - 1) == sorted(map(tuple, settings(spark, range(60), 1).collect()))
    again = KeyedTable(spark, f"file://{tmp_path}/t")
    assert held(again) == want and again.version().key == ["id"]
    assert again.merge(settings(spark, [], 3)) == n  # nothing to do makes no version
    assert sorted(map(tuple, t.lookup(spark.createDataFrame([(5,), (88,), (999,)], "id int")).collect())) == [r for r in want if r[0] in (5, 88)]
    with pytest.raises(ValueError, match="no table"):
        KeyedTable(spark, f"file://{tmp_path}/none")


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], settings(spark, [], 0).schema, buckets=16)
    t.merge(settings(spark, range(500), 1))
    before = t.version()
    t.merge(settings(spark, [7], 2))
    after = t.version()
    changed = {k for k in after.folders if after.folders[k] != before.folders[k]}
    assert len(changed) == 1
    read = t.lookup(spark.createDataFrame([(7,)], "id bigint"))
    assert read.count() == 1 and len({f.rsplit("/", 2)[1] for f in read.inputFiles()}) == 1
    bucket = spark.createDataFrame([(7,)], "id bigint").select(F.pmod(F.xxhash64("id"), F.lit(16))).first()[0]
    assert changed == {bucket}


def test_bad_keys_change_nothing(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], settings(spark, [], 0).schema, buckets=4)
    t.merge(settings(spark, range(5), 1))
    v = t.version().number
    for bad in (settings(spark, [1, 1], 2), settings(spark, [None, 3], 2)):
        with pytest.raises(ValueError, match="key is null"):
            t.merge(bad)
    assert t.version().number == v
    wide = settings(spark, [2], 5).select(F.lit("x").alias("_new"), F.lit(1).alias("_old"), "config", "id", "update_at", "create_at")
    t.merge(wide)
    assert held(t)[2] == (2, 5, 5, "c2.5")


def test_two_part_keys_and_clashing_names(spark, tmp_path):
    kind = "a string, _old string, b int, _new string, v double"
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["a", "b"], spark.createDataFrame([], kind).schema, buckets=4)
    t.merge(spark.createDataFrame([("x", "o", 1, None, 1.0), ("x", "o", 2, "n", 2.0), ("", None, 1, "n", None)], kind))
    t.merge(spark.createDataFrame([("x", "O", 2, "N", 3.0), ("y", "o", 2, "n", 4.0)], kind), update=["_new"])
    assert sorted(map(tuple, t.read().collect())) == [("", None, 1, "n", None), ("x", "o", 1, None, 1.0), ("x", "o", 2, "N", 2.0), ("y", "o", 2, "n", 4.0)]


def test_a_failing_merge_shows_nothing(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], settings(spark, [], 0).schema, buckets=4)
    t.merge(settings(spark, range(20), 1))
    want, v = held(t), t.version().number
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda self, v: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError, match="gone"):
            t.merge(settings(spark, range(10, 30), 2))
    assert held(t) == want and t.version().number == v
    assert t.vacuum() == 1 and held(t) == want  # what the merge wrote goes, what is named stays
    t.merge(settings(spark, range(10, 30), 2))
    assert len(held(t)) == 30


@pytest.mark.parametrize("overlap", [False, True])
def test_merges_at_once(spark, tmp_path, overlap):
    """Both writers start from one version; the second commits after the first, merging again only where it must."""
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], settings(spark, [], 0).schema, buckets=64)
    t.merge(settings(spark, range(100), 1))
    gate, wrote = threading.Barrier(2), []
    real = KeyedTable._written

    class Slow(KeyedTable):
        def _written(self, *a):
            out = real(self, *a)
            wrote.append(1)
            if len(wrote) <= 2:
                gate.wait(60)
            return out

    ids = ([3], [3]) if overlap else ([3], [4])
    with ThreadPoolExecutor(2) as pool:
        jobs = [pool.submit(Slow(spark, t.path).merge, settings(spark, x, 7 + k), ["config"]) for k, x in enumerate(ids)]
        versions = sorted(j.result() for j in jobs)
    assert versions == [3, 4]
    rows = {r[0]: r[3] for r in held(t)}
    assert len(rows) == 100 and len(wrote) == (3 if overlap else 2)
    assert rows[3] in ("c3.7", "c3.8") if overlap else (rows[3], rows[4]) == ("c3.7", "c4.8")


def test_batches_are_taken_once(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], settings(spark, [], 0).schema, buckets=4)
    for batch, stamp in ((0, 1), (1, 2), (1, 3), (0, 4), (2, 5)):
        t.merge(settings(spark, [1], stamp), source="s", batch=batch)
    t.merge(settings(spark, [], 9), source="s", batch=3)
    assert held(t) == [(1, 5, 5, "c1.5")] and t.version().batches == {"s": 3}


def test_upsert_still_takes_one_key(spark):
    got = relational.upsert(settings(spark, [1, 2], 1), settings(spark, [2, 3], 2), "id", ["config"])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, "c1.1"), (2, 1, 1, "c2.2"), (3, 2, 2, "c3.2")]


def test_equal_scores_are_promoted_once(spark, tmp_path):
    r = ModelRegistry(spark, f"file://{tmp_path}/r")
    assert r.latest("m") is None and r.names() == [] and r.stages().count() == 0
    for _ in range(13):
        r.register("m", 0.9651336898395722, precision=0.79)
    assert [(x.version, x.stage) for x in r.stages("m").orderBy("version").collect()] == [(1, "Production"), *((k, "None") for k in range(2, 14))]
    assert r.register("m", 0.97) == 14 and r.latest("m").version == 14 and r.latest("m", "Archived").version == 1 and r.latest("m", "None").version == 13
    r.register("other / name%", None)
    r.register("other / name%", 0.1)
    r.register("other / name%", None)
    assert {(x.version, x.stage) for x in r.stages("other / name%").collect()} == {(1, "Archived"), (2, "Production"), (3, "None")}
    assert r.names() == ["m", "other / name%"] and r.versions().count() == 17
    assert r.latest("m", "None").metrics == {"precision": 0.79}


def test_writers_at_once_get_their_own_versions(spark, tmp_path):
    r = ModelRegistry(spark, f"file://{tmp_path}/r")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: r.register("m", k / 100), range(24)))
    assert sorted(got) == list(range(1, 25))
    rows = r.versions("m").collect()
    assert {x.version: x.auc for x in rows} == {n: k / 100 for k, n in enumerate(got)}


def test_scoring_by_stage(spark, tmp_path):
    r = ModelRegistry(spark, f"file://{tmp_path}/r")
    leafs = lambda a, b: boosting.TreeModel(["x"], "logistic", 0.0, 1, [boosting.Tree([0], [2.0], [False], [a, b])])
    r.register("m", 0.5, leafs(-1.0, 1.0))
    r.register("m", 0.6, leafs(2.0, -2.0))
    r.register("m", 0.6, leafs(9.0, 9.0))
    d = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert [x.prediction for x in r.score(d, "m").collect()] == [1, 0, 1]
    assert [x.prediction for x in r.score(d, "m", "Archived").collect()] == [0, 1, 0]
    assert [round(x.probability, 4) for x in r.score(d, "m", "None").collect()] == [0.9999] * 3
    with pytest.raises(LookupError):
        r.score(d, "nobody")
    assert keyed.CommitLog is CommitLog
