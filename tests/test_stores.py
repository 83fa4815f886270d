"""Mirrors over tasks, table replacement, JDBC, and routing with state that expires."""

import os
import time

import pytest

from lakeloom.sources import readers, sinks, stores
from lakeloom.streaming import routing


def fill(root, files):
    for name, text in files.items():
        f = root / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


def held(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def did(df):
    return {r.key: r.action for r in df.collect()}


def test_mirror(spark, tmp_path):
    a, b = tmp_path / "a b", tmp_path / "b"
    fill(a, {"x.txt": "x", "d/y.txt.gz": "not gzip", "d/e/.keep": "", "d/same": "s", "é/ü": "u", "newer": "2"})
    fill(b, {"old": "o", "d/e/gone": "g", "d/same": "s", "newer": "1"})
    os.utime(b / "newer", (1, 1))
    got = did(stores.mirror_files(spark, str(a), f"file://{b}"))
    assert got == {"x.txt": "copied", "d/y.txt.gz": "copied", "d/e/.keep": "copied", "é/ü": "copied", "d/same": "kept", "newer": "copied", "old": "deleted", "d/e/gone": "deleted"}
    assert held(a) == held(b)
    assert set(did(stores.mirror_files(spark, str(a), str(b))).values()) == {"kept"}  # a rerun does nothing
    assert did(stores.mirror_files(spark, str(tmp_path / "nothing"), str(tmp_path / "nowhere"))) == {}
    assert set(did(stores.mirror_files(spark, str(tmp_path / "nothing"), str(b))).values()) == {"deleted"} and held(b) == {}


def test_a_failing_mirror_is_finished_by_the_next(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    fill(a, {f"d{i}/f{j}": f"{i}{j}" for i in range(4) for j in range(5)})
    (b / "d2/f3/in the way").mkdir(parents=True)  # a folder where a file has to go
    fill(b, {"d9/old": "o"})
    with pytest.raises(Exception, match="d2/f3|directory"):
        stores.mirror_files(spark, str(a), str(b))
    assert all(v == held(a).get(k, v) for k, v in held(b).items()) and not [k for k in held(b) if "/." in k]
    (b / "d2/f3/in the way").rmdir()
    (b / "d2/f3").rmdir()
    stores.mirror_files(spark, str(a), str(b))
    assert held(a) == held(b)


def test_replaced_table(spark):
    sinks.create_tables(spark, {"swap": "k int"})
    sinks.append_rows(spark.createDataFrame([(1,), (2,), (3,)], "k int"), "swap")
    sinks.replace_table(spark.table("swap").where("k > 1"), "swap")
    sinks.replace_table(spark.table("swap").where("k > 2"), "swap")
    assert [r.k for r in spark.table("swap").collect()] == [3]
    assert not spark.catalog.tableExists("swap_incoming") and not spark.catalog.tableExists("swap_before")
    sinks.drop_tables(spark, ["swap"])


def test_jdbc_table(spark):
    url = "jdbc:derby:memory:shop;create=true"
    spark.range(100).selectExpr("id AS n", "concat('c', id) AS name").write.jdbc(url, "customers")
    d = readers.jdbc_table(spark, url, "customers", "n", 0, 100, 4)
    assert d.rdd.getNumPartitions() == 4 and d.count() == 100 and d.where("n = 7").first().name == "c7"


MESSAGES = "user_id bigint, seq bigint, label string, muc_dich string, thu_nhap string, han_muc string"


def test_routing_and_abandoned_fillings(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "ck"))
    with pytest.raises(ValueError, match="RocksDB"):
        routing.routed_slots(spark.readStream.schema(MESSAGES).json(str(tmp_path)))
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def send(rows, expected, abandon=30.0):
        """One run of the query, started anew from its checkpoint; what it says of these messages."""
        before = {tuple(r) for r in spark.read.schema(routing.OUTPUT).json(sink).collect()} if (tmp_path / "out/_spark_metadata").exists() else set()
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").json(source)
        q = routing.routed_slots(spark.readStream.schema(MESSAGES).json(source), abandon).writeStream.format("json").option("path", sink).option("checkpointLocation", check).start()
        until = time.time() + 60
        while time.time() < until and not q.exception():  # timers keep a query going, so it is stopped once all is said
            done = {tuple(r) for r in spark.read.schema(routing.OUTPUT).json(sink).collect()} if (tmp_path / "out/_spark_metadata").exists() else set()
            if len(done - before) >= expected:
                break
            time.sleep(0.3)
        q.stop()
        return sorted((r.user_id, r.seq, r.route, r.event, r.next_slot, r.n_answers) for r in spark.read.schema(routing.OUTPUT).json(sink).collect() if tuple(r) not in before)

    try:
        card, product = "CREDIT_CARD", "PRODUCT_INFO"
        assert send([(1, 2, product, "a", None, None), (1, 1, card, None, None, None), (2, 5, product, None, None, None), (3, 1, None, None, None, None), (None, 1, card, None, None, None)], 4) == [
            (1, 1, card, "started", "muc_dich", 0),
            (1, 2, card, "asked", "thu_nhap", 1),  # filling holds the user, whatever the label
            (2, 5, product, "elsewhere", "muc_dich", 0),
            (3, 1, None, "elsewhere", "muc_dich", 0),
        ]
        assert send([(1, 2, card, "again", None, None), (1, 3, product, None, "b", "c"), (2, 4, card, None, None, None)], 3) == [
            (1, 2, card, "late", "thu_nhap", 1),
            (1, 3, card, "recommended", None, 2),
            (2, 4, card, "late", "muc_dich", 0),
        ]
        assert send([(1, 4, product, None, None, None), (1, 5, card, None, None, None), (4, 1, card, None, None, None)], 3, abandon=1 / 20) == [
            (1, 4, product, "elsewhere", None, 2),
            (1, 5, card, "confirm", None, 2),
            (4, 1, card, "started", "muc_dich", 0),
        ]
        time.sleep(3)
        got = send([(5, 1, product, None, None, None)], 3, abandon=1 / 20)
        assert {x[3] for x in got if x[0] in (1, 4)} == {"abandoned"} and (4, 1, card, "abandoned", "muc_dich", 0) in got
        assert send([(4, 2, card, "x", None, None)], 1)[0][:4] == (4, 2, card, "started")
    finally:
        spark.conf.unset(key)
