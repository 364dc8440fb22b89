"""Boxes, grids, capture and tracks against plain loops."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import geometry as G
from recollect.plans import perception, streams
from recollect.streaming import capture, run, tracker


def box(l, t, r, b):
    return F.struct(F.lit(float(l)).alias("l"), F.lit(float(t)).alias("t"), F.lit(float(r)).alias("r"), F.lit(float(b)).alias("b"))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 2, 2), (0, 0, 2, 2), 1.0), ((0, 0, 1, 1), (2, 2, 3, 3), 0.0), ((0, 0, 2, 2), (1, 0, 3, 2), 2 / 6)])
def test_iou(spark, a, b, want):
    assert value(spark, G.iou(box(*a), box(*b))) == pytest.approx(want)


@pytest.mark.parametrize(
    ("b", "side", "want"),
    [((100, 100, 200, 200), 1000, (80, 80, 220, 220)), ((-10, -10, 50, 50), 100, (0, 0, 62, 62)), ((950, 950, 1000, 1000), 1000, (940, 940, 1000, 1000)), ((5, 5, 5, 5), 100, (5, 5, 6, 6))],
)
def test_padded(spark, b, side, want):
    assert tuple(value(spark, G.padded(box(*b), side, side))) == want


@pytest.mark.parametrize(("similarity", "apart", "want"), [(1.0, 2000, "SKIP"), (0.5, 9000, "CAPTURE"), (1.0, 46000, "HEARTBEAT"), (0.5, 1500, "SKIP"), (None, 0, "CAPTURE")])
def test_gate(spark, similarity, apart, want):
    assert value(spark, capture.decision(F.lit(similarity).cast("double"), F.lit(apart))) == want == capture.decide(similarity, apart, capture.CHANGED)


def test_grids(spark):
    white = F.array(*[F.lit(255.0)] * 4)
    assert value(spark, G.downscaled(white, 2, 2, 32)) == [1.0] * 1024
    assert value(spark, G.similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    flat, edge = F.array(*[F.lit(0.5)] * 16), F.array(*[F.lit(float(i % 4 > 1)) for i in range(16)])
    assert value(spark, G.sharpness(flat, 4)) == 0.0 < value(spark, G.sharpness(edge, 4))


def test_suppression_is_greedy(spark, small):
    d = perception.detections(spark, small)
    boxes = {}
    for r in d.collect():
        boxes.setdefault((r.frame, r.label), []).append((-r.score, r.det, tuple(r.box)))
    kept = []
    for key, found in boxes.items():
        stay = []
        for s, det, b in sorted(found):
            if all(tracker.overlap(b, x) <= G.SUPPRESS for _, _, x in stay):
                stay.append((s, det, b))
        kept += [(*key, det) for _, det, _ in stay]
    assert sorted((r.frame, r.label, r.det) for r in G.suppressed(d).collect()) == sorted(kept)


def test_tracks():
    t = tracker.Tracker()
    det = lambda label, *b: {"label": label, "score": 0.9, "box": b}
    assert [t.update([det("cup", 0, 0, 10, 10)])[0] for _ in range(3)] == [(1, 1), (1, 2), (1, 3)]
    assert t.update([det("dog", 0, 0, 10, 10)]) == [(2, 1)]  # another label
    assert t.update([det("cup", 50, 50, 60, 60), det("cup", 1, 0, 11, 10)]) == [(3, 1), (1, 4)]
    for _ in range(16):
        t.update([])
    assert t.update([det("cup", 0, 0, 10, 10)]) == [(4, 1)]  # forgotten after more than 15 ticks


def test_stretches_are_followed_apart(spark):
    rng = random.Random(3)
    rows, tick = [], 0
    for _ in range(60):
        tick += rng.choice([1, 1, 1, 2, 9, 16, 17, 18, 40])
        for det in range(rng.randrange(1, 4)):
            left = rng.choice([0.0, 1.0, 30.0])
            rows.append((5, tick, det, rng.choice(["cup", "dog"]), 0.9, (left, 0.0, left + 10, 10.0)))
    d = spark.createDataFrame(rows, "camera long, tick long, det int, label string, score double, box struct<l double, t double, r double, b double>")
    t, want, at = tracker.Tracker(), [], 0
    for now in sorted({r[1] for r in rows}):
        while at < now - 1:
            at += 1
            t.update([])
        at = now
        frame = [r for r in rows if r[1] == now]
        found = t.update([{"label": r[3], "score": r[4], "box": r[5]} for r in frame])
        want += [(5, now, r[2], track, seen) for r, (track, seen) in zip(frame, found, strict=True)]
    assert sorted(map(tuple, tracker.tracked(d, numbered=True).collect())) == sorted(want)


def test_tracks_of_a_table(spark, small):
    from recollect.plans import registry
    from recollect.plans.perception import detections

    rows = detections(spark, small).selectExpr("frame % 97 AS camera", "frame AS tick", "det", "label", "score", "box").collect()
    want = []
    for camera in {r.camera for r in rows}:
        t, mine = tracker.Tracker(), [r for r in rows if r.camera == camera]
        for now in sorted({r.tick for r in mine}):
            frame = sorted((r for r in mine if r.tick == now), key=lambda r: (r.det, r.label, r.score))
            found = t.update([{"label": r.label, "score": r.score, "box": tuple(r.box)} for r in frame])
            want += [(camera, now, r.det, track, seen) for r, (track, seen) in zip(frame, found, strict=True)]
    assert sorted(map(tuple, registry.queries()["trk_tracks"](spark, small).collect())) == sorted(want)


def test_capture_stream_equals_batch_and_loop(spark, small):
    batch = capture.moments_batch(streams.frames(spark, small, False), 0.99, 0.90)
    found = sorted(tuple(r) for r in batch.collect())
    streamed = run.available_now(capture.moments_stream(streams.frames(spark, small, True), 0.99, 0.90))
    assert found == sorted(tuple(r) for r in streamed.collect()) and found
    cameras, plain = {}, []
    for r in streams.frames(spark, small, False).orderBy("ts", "id").collect():
        c = cameras.setdefault(r.camera, capture.Camera(0.99, 0.90))
        kept = c.step({"id": r.id, "ts": r.ts, "grid": list(r.grid), "vec": list(r.vec), "sharp": r.sharp})
        plain += [(r.camera, *kept.values())] if kept else []
    assert found == sorted(plain)


def test_sessions_of_the_stream_are_among_the_batch(spark, small):
    from recollect.plans import registry

    batch = {tuple(r) for r in registry.queries()["batch_session_segments"](spark, small).collect()}
    streamed = {tuple(r) for r in registry.queries()["stream_session_segments"](spark, small).collect()}
    assert streamed and streamed <= batch


def test_spacing():
    assert capture.spaced([0, 10, 33, 40, 70], 33) == [True, False, True, False, True]


def test_step_state_survives_json():
    c = capture.Camera()
    c.step({"id": 1, "ts": 5, "grid": [0.1], "vec": [1.0], "sharp": 0.2})
    from dataclasses import asdict

    assert capture.Camera(**json.loads(json.dumps(asdict(c)))) == c
    assert np.isclose(c.best["sharp"], 0.2)
