"""The index by ranges: which files a window or a page reads; the side branch of a stream; one pull at a time."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from recollect.operators import scan, sync
from recollect.sources.ranges import RangeIndex
from recollect.streaming import branch, run


def files_read(df):
    """Rows, and how many files their scan opened."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()) if leaves.apply(k).metrics().contains("numFiles"))


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan that ran can be looked at
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_windows_and_pages_read_few_files(spark, plain_plans):
    rng = random.Random(4)
    rows = [(k, rng.choice(["frame", "ocr"]), 5_000_000 if k % 3 == 0 else rng.randrange(10_000_000), "car" if k % 400 == 1 else "") for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, type string, timestamp_ms long, label string")
    index = RangeIndex.build(df, run.shared_folder(spark), slot_rows=200)
    index.append(df.withColumn("id", F.col("id") + 10_000).filter("id % 10 = 0"))
    df = df.unionByName(df.withColumn("id", F.col("id") + 10_000).filter("id % 10 = 0"))
    everything = len(index.rows().inputFiles())
    frames = df.filter("type = 'frame'")
    cases = [
        (index.first(50, "frame"), scan.newest(frames, 50)),
        (index.first(50, "frame", 2_000_000, 7_500_000), scan.newest(frames.filter("timestamp_ms BETWEEN 2000000 AND 7500000"), 50)),
        (index.first(7, "frame", None, 1_000_003), scan.newest(frames.filter("timestamp_ms <= 1000003"), 7)),
        (index.page(40, 3_333_333, "ocr"), df.filter("type = 'ocr' AND timestamp_ms > 3333333").orderBy("timestamp_ms", "id").limit(40)),
    ]
    for found, want in cases:
        rows, files = files_read(found)
        assert [tuple(r)[:4] for r in rows] == [tuple(r)[:4] for r in want.select(*found.columns).collect()] and 0 < files < everything / 8, (files, everything)
    rows, files = files_read(index.window("frame", 4_999_000, 5_000_100))  # the slot that holds a third of all rows
    assert len(rows) == frames.filter("timestamp_ms BETWEEN 4999000 AND 5000100").count() and files < everything / 4
    rare = index.first(12, where=F.col("label") == "car")
    assert [r.id for r in rare.collect()] == [r.id for r in scan.newest(df.filter("label = 'car'"), 12).collect()]
    few = index.first(500, where=F.col("label") == "car")
    assert few.count() == df.filter("label = 'car'").count() < 500
    none = RangeIndex.build(df.limit(0), run.shared_folder(spark))
    assert none.first(5).count() == 0 and none.window(since=3).count() == 0


def test_a_failing_branch_loses_no_frame(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("moment_id")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = lambda: spark.readStream.schema("moment_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def some(frame):
        if frame["moment_id"] % 4 == 0:
            raise RuntimeError("unreadable")
        return [(0, f"text {frame['moment_id']}", 0.0, 0.0, 1.0, 1.0)]

    frames, lines, failed = branch.with_lines(stream(), some)
    assert sorted(r[0] for r in frames.collect()) == list(range(30))
    assert sorted(r.moment_id for r in lines.collect()) == [k for k in range(30) if k % 4]
    assert {(r.moment_id, r.error) for r in failed.collect()} == {(k, "RuntimeError: unreadable") for k in range(0, 30, 4)}
    # the branch as a whole: what it gives can't be written
    frames, lines, failed = branch.with_lines(stream(), lambda frame: [(0, 1, 2)])
    assert frames.count() == 30 and lines.count() == 0 and failed.count() == 3


def test_of_two_pulls_one_runs(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "source"))
    s, found, begun = sync.Snapshots(spark, str(tmp_path / "hub")), [], threading.Event()

    class Slow(sync.Snapshots):
        def pull(self, source):
            begun.set()
            time.sleep(2)
            return super().pull(source)

    first = threading.Thread(target=lambda: found.append(Slow(spark, s.root).pull_alone(str(tmp_path / "source"))))
    first.start()
    begun.wait(30)
    assert s.pull_alone(str(tmp_path / "source")) == ("busy", None)
    first.join()
    assert found == [("loaded", 5)] and s.load().count() == 5
    assert len([p for p in (tmp_path / "hub").iterdir() if p.name.startswith("snapshot")]) == 1  # one of them staged
    assert s.pull_alone(str(tmp_path / "source")) == ("loaded", 5)  # given back


def test_a_lease_ends_and_is_taken_over(spark, tmp_path):
    s = sync.Snapshots(spark, str(tmp_path / "hub"))
    (tmp_path / "hub").mkdir()
    old = s.acquire(0.2)
    assert old and s.acquire() is None
    time.sleep(0.4)
    new = s.acquire()
    assert new and new != old
    assert not s.release(old) and s.acquire() is None and s.release(new) and s.acquire()
    got, threads = [], []
    s.fs.delete(s.path(f"{s.root}/lease"), False)
    for _ in range(6):
        threads.append(threading.Thread(target=lambda: got.append(s.acquire())))
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len([x for x in got if x]) == 1


def test_slots_dont_grow_with_the_rows_until_they_are_full(spark, small):
    from recollect.plans import collection

    for folder in (small, "/root/testdata/sf0.1"):
        index = collection.indexed(spark, folder)
        assert 10 <= spark.read.parquet(f"{index.path}/slots").select("slot").distinct().count() <= 22
        assert index.rows().count() == collection.points(spark, folder).count()
    n = 3000
    rows = spark.range(n).select("id", F.lit("frame").alias("type"), F.col("id").alias("timestamp_ms"))
    assert RangeIndex.build(rows, run.shared_folder(spark), slot_rows=100, slots=20).width == 100
