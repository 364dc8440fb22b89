"""The store, the searcher, encoders and reports."""

import pytest
from pyspark.sql import functions as F

from recollect.plans.searcher import MomentSearcher, answer, repository_search
from recollect.sources import encoders, reports
from recollect.sources.store import MomentStore, sync_all, sync_once

ENCODE = encoders.hashing_encoder(16)
NOW = 1786968000000


@pytest.fixture
def store(spark, tmp_path):
    s = MomentStore(spark, str(tmp_path / "store"), 16, 8)
    frames = [(f"m{k}", NOW - k * 3_600_000, ENCODE([w])[0]) for k, w in enumerate(["wallet", "keys", "dog", "lamp"])]
    s.store_moments(spark.createDataFrame(frames, "id string, timestamp_ms long, clip array<float>"))
    regions = [("r0", "m0", NOW, "cup", 0.9, 0.8, ENCODE(["cup"])[0]), ("r1", "m2", NOW, "", 0.5, 0.0, ENCODE(["dog"])[0])]
    s.store_regions(spark.createDataFrame(regions, "id string, moment_id string, timestamp_ms long, label string, yolo_conf double, verify_cos double, clip array<float>"))
    s.store_ocr(spark.createDataFrame([("t0", "m3", NOW, "exit", [1.0] * 8), ("t1", "m3", NOW, "  ", [1.0] * 8)], "id string, moment_id string, timestamp_ms long, text string, text_vec array<float>"))
    return s


def test_channels_and_counts(spark, store):
    assert store.count() == 7 and store.frame_count() == 4
    assert [r.id for r in store.timeline(2).collect()] == ["m1", "m0"]  # the newest, oldest first
    assert [r.id for r in store.frames_in_window(NOW - 7_200_000, None).collect()] == ["m0", "m1", "m2"]
    best = store.search_frames(ENCODE(["dog"])[0], 1).first()
    assert best.id == "m2" and best.score == pytest.approx(1) and best.moment_id == "m2"
    assert store.search_text([1.0] * 8).first().text == "exit"


def test_wrong_vectors_are_refused(spark, store):
    bad = spark.createDataFrame([("x", 1, [1.0])], "id string, timestamp_ms long, clip array<float>")
    with pytest.raises(Exception, match="16 numbers"):
        store.store_moments(bad)
    with pytest.raises(Exception, match="blank"):
        store.store_regions(spark.createDataFrame([("x", " ", 1, [1.0] * 16)], "id string, moment_id string, timestamp_ms long, clip array<float>"))
    with pytest.raises(ValueError, match="16 numbers"):
        store.search_frames([1.0])
    assert store.count() == 7


def test_search(spark, store):
    s = MomentSearcher(store, ENCODE)
    assert s.search("where is my dog", NOW).cards[0].id == "m2"
    assert s.search("where is the cup", NOW).cards[0].id == "m0"  # its label accepts it
    assert [c.id for c in s.search("what did i see today", NOW).cards] == ["m0", "m1", "m2", "m3"]
    assert s.search("x", NOW).cards == [] and s.search("dog last month", NOW).cards == []
    broken = MomentSearcher(store, lambda _: 1 / 0)
    assert broken.search("dog", NOW).unavailable.startswith("ZeroDivisionError")
    deaf = MomentSearcher(store, ENCODE, encode_text=lambda _: 1 / 0)
    assert deaf.search("dog", NOW).cards[0].id == "m2"


def test_hub(spark, store, tmp_path):
    hub = MomentStore(spark, str(tmp_path / "hub"), 16, 8)
    assert sync_once(store, hub, recording=True) == 0
    assert sync_once(store, hub) == 4 and hub.frame_count() == 4
    assert sync_once(store, hub) == 0 and hub.frame_count() == 4
    assert MomentSearcher(store, ENCODE, hub=hub).search("dog", NOW).cards[0].source == "local"
    store.delete_all()
    assert store.count() == 0
    assert MomentSearcher(store, ENCODE, hub=hub).search("dog", NOW).cards[0].source == "fleet"


def test_repository(spark, store):
    assert repository_search(store, "dog", ENCODE).first().id == "m2"
    assert repository_search(store, " ", ENCODE).first().id == "m0"
    assert repository_search(store, "dog", None).first().id == "m0"


def test_encoders(spark):
    df = encoders.encoded(spark.createDataFrame([("a dog",), (None,)], "t string"), "t", ENCODE)
    rows = df.withColumn("ok", encoders.sound(F.col("vector"), 16)).withColumn("bad", encoders.sound(F.col("vector"), 8)).withColumn("h", encoders.half(F.col("vector"))).collect()
    assert all(r.ok and not r.bad for r in rows) and rows[0].h == pytest.approx(rows[0].vector, abs=1e-3)
    assert answer([], " ") == "Ничего не нашёл." and answer([1, 2]) == "Нашёл 2." and answer([1], "hi") == "hi"


def test_reports(spark, tmp_path):
    reports.write_csv(spark.createDataFrame([("search", 1, 2.5)], "op string, run int, ms double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().ms == "2.5"
    (tmp_path / "d" / "ns_one").mkdir(parents=True)
    (tmp_path / "d" / "ns-two").mkdir()
    (tmp_path / "d" / "ns_one" / "a").write_bytes(b"123")
    (tmp_path / "d" / "ns-two" / "b").write_bytes(b"12")
    assert reports.disk_usage(spark, str(tmp_path / "d"), "two").first().bytes == 2
    assert reports.given_up([200, 100, 100]) and not reports.given_up([100, 200, 100])
    assert reports.timing([3, 1, 2, 4])["median"] == 3
    v = reports.clustered(300, 8)
    assert v.shape == (300, 8) and abs((v * v).sum(1) - 1).max() < 1e-5
    assert reports.markdown([{"n": 1, "ms": 2}]).splitlines()[0] == "| n | ms |"


def test_passes_go_together_and_send_what_single_ones_do(spark, tmp_path):
    """Whole passes share a change of the store and one of the hub, which were a change for each pass before."""
    made = {}
    for way in ("together", "alone"):
        s, hub = (MomentStore(spark, str(tmp_path / f"{way}-{x}"), 2, 2) for x in ("store", "hub"))
        frames = spark.range(430).select(F.format_string("m%03d", "id").alias("id"), F.array(F.lit(1.0), F.col("id").cast("float")).cast("array<float>").alias("clip"))
        s.store_moments(frames)
        # some frames can't be mapped
        s.upsert(s.points().filter("id LIKE 'm%7'").withColumn("clip", F.lit(None).cast("array<float>")))
        before = len(s.log.numbers())
        if way == "together":
            made[way] = sync_all(s, hub)
            assert len(s.log.numbers()) - before == 2 and len(hub.log.numbers()) == 3
        else:
            passes = sent = 0
            while n := sync_once(s, hub):
                passes, sent = passes + 1, sent + n
            made[way] = (passes, sent)
        assert sorted(r.id for r in hub.points().select("id").collect()) == [f"m{k:03d}" for k in range(430) if k % 10 != 7]
        assert s.points().filter("NOT synced").count() == 43
    assert made["together"] == made["alone"] == (4, 387)


def test_unmappable_frames_in_front_are_passed_one_by_one(spark, tmp_path):
    s, hub = (MomentStore(spark, str(tmp_path / x), 2, 2) for x in ("store", "hub"))
    first = spark.range(1100).select(F.format_string("m%04d", "id").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("clip"))
    s.store_moments(first)
    s.upsert(s.points().withColumn("clip", F.when(F.col("id") >= "m0950", F.col("clip"))))
    # a pass examines a thousand, of which 950 can't be sent: three passes of fifty
    assert sync_all(s, hub) == (3, 150) and hub.count() == 150
