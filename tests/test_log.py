"""The store's log: what a change writes, what a reader sees, and two writers at once."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect.sources import log as L
from recollect.sources.store import MomentStore, sync_all, sync_once

COLUMNS = StructType().add("id", "string").add("n", "long").add("synced", "boolean").add("type", "string")


def made(spark, path, n=1000):
    log = L.Log(spark, str(path), COLUMNS, parts=("type",))
    log.replace(spark.range(n).selectExpr("cast(id AS string) AS id", "id AS n", "false AS synced", "if(id % 2 = 0, 'frame', 'ocr') AS type"))
    return log


def rows(log, number=None):
    return {r.id: (r.n, r.synced, r.type) for r in log.read(number).collect()}


def test_versions_against_a_dictionary(spark, tmp_path):
    log = made(spark, tmp_path / "t", 40)
    want = rows(log)
    of = lambda *ids: spark.createDataFrame([(str(i),) for i in ids], "id string")
    put = lambda *r: spark.createDataFrame([(str(i), n, s, "frame") for i, n, s in r], COLUMNS)
    history = [dict(want)]
    steps = [
        (lambda: log.put(put((1, 100, False), (99, 5, None))), {"1": (100, False, "frame"), "99": (5, None, "frame")}, []),
        (lambda: log.set_flag(of(1, 2, 99, 777)), {"1": (100, True, "frame"), "2": (2, True, "frame"), "99": (5, True, "frame")}, []),
        (lambda: log.put(put((2, 200, False))), {"2": (200, False, "frame")}, []),  # put anew, it has the flag it was put with
        (lambda: log.remove(of(3, 99, 555)), {}, ["3", "99"]),
        (lambda: log.put(put((3, 300, False))), {"3": (300, False, "frame")}, []),
        (lambda: log.set_flag(of(3, 4)), {"3": (300, True, "frame"), "4": (4, True, "frame")}, []),
    ]
    for change, new, gone in steps:
        change()
        want = {k: v for k, v in {**want, **new}.items() if k not in gone}
        history.append(dict(want))
        assert rows(log) == want
    for number, then in enumerate(history):  # older versions are whole, too
        assert rows(log, number) == then
    log.merge()
    assert rows(log) == want
    log.compact()
    assert log.manifest()["deltas"] == [] and rows(log) == want
    assert log.vacuum() > 0 and rows(log) == want
    log.replace(log.read().limit(0))
    assert rows(log) == {}


def test_merging_keeps_the_order_of_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MERGED", 4)
    monkeypatch.setattr(L, "PART", 1e9)
    log = made(spark, tmp_path / "t", 10)
    one = lambda n: spark.createDataFrame([("1", n, False, "frame")], COLUMNS)
    id_ = spark.createDataFrame([("1",)], "id string")
    for k in range(3):
        log.put(one(k))
        log.set_flag(id_)
        log.remove(id_)
    assert "1" not in rows(log) and len(log.manifest()["deltas"]) <= 4
    log.put(one(7))
    assert rows(log)["1"] == (7, False, "frame")
    log.set_flag(id_)
    log.merge()
    assert rows(log)["1"] == (7, True, "frame") and len(rows(log)) == 10


def test_writers_of_the_same_ids_do_not_double_them(spark, tmp_path):
    log, failed = made(spark, tmp_path / "t", 10), []

    def write(k):
        try:
            for j in range(3):
                L.Log(spark, log.root, COLUMNS, parts=("type",)).put(spark.createDataFrame([("new", k, False, "frame"), (f"own {k} {j}", k, False, "frame")], COLUMNS))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert log.read().count() == log.read().select("id").distinct().count() == 10 + 1 + 9
    assert log.manifest()["number"] == 9


def test_a_version_that_is_there_is_not_written_again(spark, tmp_path):
    log = made(spark, tmp_path / "t", 4)
    with pytest.raises(L.Conflict):
        log._create({"number": 0, "base": None, "deltas": []})
    assert log.read().count() == 4


def test_a_pass_of_the_sync_writes_its_batch(spark, tmp_path):
    s, hub = (MomentStore(spark, str(tmp_path / name), 32, 8) for name in ("s", "hub"))
    n = 3000
    frames = spark.range(n).select(F.format_string("m%05d", "id").alias("id"), (F.col("id") * 1000).alias("timestamp_ms"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.rand(1).cast("float")).alias("clip"))
    s.store_moments(frames)
    s.log.compact()
    whole = s.log.size(s.log.manifest()["base"])
    before = s.log.read()
    assert sync_once(s, hub) == 100
    deltas = s.log.manifest()["deltas"]
    assert len(deltas) == 1 and s.log.size(deltas[0]["path"]) < whole / 20
    assert s.log.size(hub.log.manifest()["deltas"][-1]["path"]) < whole / 10
    # a reader that began before the pass still reads its version whole
    assert before.filter("synced").count() == 0 and before.count() == n
    assert s.points().filter("synced").count() == 100 and s.count() == n
    view = s.points().filter("type = 'frame'").select("id", "synced")
    view.collect()
    plan = view._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "= frame" in plan
    assert sync_all(s, hub)[1] == n - 100 and hub.count() == n and s.points().filter("NOT synced").count() == 0
