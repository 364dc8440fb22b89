"""Shared corpus: mapping, flags, snapshots; label vectors."""

import pytest

from recollect.operators import sync
from recollect.sources import moments as M

UUID = "12345678-1234-1234-1234-1234567890ab"


def test_records_that_cannot_be_mapped_are_left_out(spark):
    rows = [
        (UUID, "[1.0, 2.0]", '{"type":"frame","synced":true}'), (UUID, '{"clip":{"dense":[1,2]}}', '{"type":"frame"}'), (UUID, '{"clip":[1,2]}', "{}"),
        ("7", "[1.0]", "{}"), (UUID, None, "{}"), (UUID, "[]", "{}"), (UUID, '{"indices":[1],"values":[2]}', "{}"), (UUID, "[1]", "{broken"), (UUID, "[1]", "7"), (UUID, "[1]", None),
    ]
    out = sync.to_fleet(spark.createDataFrame(rows, "id string, vector string, payload string")).collect()
    assert [r.vector for r in out] == [[1.0, 2.0]] * 3
    assert out[0].payload == {"type": "frame"}


def test_upsert_twice_changes_nothing(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    b = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, x string")
    once = sync.upsert(a, b)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sync.upsert(once, b).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_mark_synced_touches_only_its_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, False, "y")], "id long, synced boolean, label string")
    none = sync.mark_synced(df, df.limit(0))
    assert sorted(map(tuple, none.collect())) == [(1, None, "x"), (2, False, "y")]
    assert sorted(map(tuple, sync.mark_synced(df, df.filter("id = 1")).collect())) == [(1, True, "x"), (2, False, "y")]


def test_snapshots(spark, tmp_path):
    s = sync.Snapshots(spark, str(tmp_path / "root"))
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError):
        s.load()
    assert s.pull(str(tmp_path / "a")) == ("loaded", 3) and s.load().count() == 3
    assert s.pull(str(tmp_path / "empty")) == ("empty", 0) and s.load().count() == 3
    state, rows = s.pull(str(tmp_path / "nothing"))
    assert state.startswith("unreachable") and rows is None and s.load().count() == 3
    spark.range(5).write.parquet(str(tmp_path / "b"))
    assert s.pull(str(tmp_path / "b")) == ("loaded", 5) and s.load().count() == 5


def test_label_vectors(spark, tmp_path):
    (tmp_path / "labels.tsv").write_text("cup\t1,2\nbad\nshort\t1\ndog\t3,x\ncup\t5,6\n\t1,2\n")
    assert [tuple(r) for r in M.label_vectors(spark, str(tmp_path / "labels.tsv"), 2).collect()] == [("cup", [5.0, 6.0])]
