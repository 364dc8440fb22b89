"""Lanes, pushes and stores by plain loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from recollect.sources import legacy, reports, store
from recollect.streaming import push, run


def streamed(spark, tmp_path, rows, schema, files):
    """A stream of ``files`` files, taken one by one."""
    folder = str(tmp_path / "in")
    for k in range(files):
        spark.createDataFrame(rows[k::files] if files == 1 else rows[len(rows) * k // files : len(rows) * (k + 1) // files], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("files", [1, 4])
def test_paced_over_batches(spark, tmp_path, files):
    rng = random.Random(files)
    rows = sorted(((k % 3, k, rng.randrange(1000), rng.randrange(60)) for k in range(200)), key=lambda r: r[2])
    got = {(r.key, r.id) for r in run.available_now(push.paced(streamed(spark, tmp_path, rows, "key long, id long, ts long, hold long", files))).collect()}
    free, want = {}, set()
    for key, one, ts, hold in sorted(rows, key=lambda r: (r[2], r[1])):
        if ts >= free.get(key, -1):
            free[key] = ts + hold
            want.add((key, one))
    assert got == want


def test_push_drops_what_a_viewer_misses(spark, tmp_path):
    rows = [(f"event {k}",) for k in range(250)]
    stream = streamed(spark, tmp_path, rows, "event string", 2)
    inbox = str(tmp_path / "inbox")
    os.makedirs(inbox)

    def send(name, messages):
        if "event 3" in messages:
            raise OSError("away")
        with open(os.path.join(inbox, name), "w") as f:
            f.write("\n".join(messages))

    push.push(stream, str(tmp_path / "state"), send, 50)
    told = [x for name in os.listdir(inbox) for x in open(os.path.join(inbox, name)).read().split("\n")]
    assert len(told) == 200 and "event 3" not in told and len(set(told)) == 200


def test_upsert_writes_its_rows_alone(spark, tmp_path):
    s = store.MomentStore(spark, str(tmp_path / "s"), 2, 2)
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, clip array<float>")
    s.store_moments(rows)
    other = s.points().withColumn("id", F.concat("id", F.lit("2")))
    s.upsert(other)
    assert s.count() == 4
    s.upsert(s.points().filter("id = 'a'").withColumn("label", F.lit("new")))
    assert len(s.log.manifest()["deltas"]) == 3 and s.count() == 4 and s.points().filter("label = 'new'").count() == 1
    assert store.count_or_none(None) == 0 and store.count_or_none(s) == 4


def test_thumbs_and_wav(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 4608),), (bytearray(b"x" * 4609),), (bytearray(b""),), (None,)], "b binary")
    assert [len(r.t or "") for r in df.select(legacy.thumb_b64(F.col("b")).alias("t")).collect()] == [6144, 0, 0, 0]
    head = bytes(df.filter("b IS NOT NULL").limit(1).select(legacy.wav_file(F.col("b")).alias("w")).first().w)[:44]
    import io
    import wave

    w = wave.open(io.BytesIO(head + b"x" * 4608))
    assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 2, 16000, 2304)


def test_given_up(spark):
    rates = [200, 100, 200, 100, 100, 100]
    df = spark.createDataFrame([(1, k, float(r)) for k, r in enumerate(rates)] + [(2, 0, 1.0)], "key int, chunk int, rate double")
    assert [tuple(r) for r in reports.slow_runs(df).collect()] == [(1, 4)] and reports.given_up(rates) and not reports.given_up(rates[:4])
