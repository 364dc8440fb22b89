"""Automata on streams that come in several batches, against plain loops and their batch twins."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recollect.operators import intervals
from recollect.plans import registry
from recollect.streaming import live, run, tracker


def in_files(spark, rows, schema, cuts):
    """A stream that reads one file a batch: the rows cut at the given places."""
    place = run.shared_folder(spark)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{place}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(place)


BOX = "box struct<l double, t double, r double, b double>"


def seen(seed=3):
    rng, rows = random.Random(seed), []
    for camera in (1, 2):
        tick = 10
        for _ in range(50):
            tick += rng.choice([1, 1, 1, 2, 9, 16, 17, 18, 40])
            for det in range(rng.randrange(1, 4)):
                left = rng.choice([0.0, 1.0, 30.0])
                rows.append((camera, tick, det, rng.choice(["cup", "dog"]), 0.9, (left, 0.0, left + 10, 10.0)))
    return sorted(rows, key=lambda r: (r[1], r[0], r[2]))


def test_tracks_of_batches_that_split_frames(spark):
    rows = seen()
    schema = f"camera long, tick long, det int, label string, score double, {BOX}"
    want = sorted(map(tuple, tracker.tracked(spark.createDataFrame(rows, schema), numbered=True).collect()))
    # cut within frames, and the rows of neighbouring frames in disorder
    mixed = [r for k in range(0, len(rows), 4) for r in reversed(rows[k : k + 4])]
    s = in_files(spark, mixed, schema, [37, 71, 72, 150])
    s = s.withColumn("at", F.timestamp_millis(F.col("tick") * live.TICK))
    tick = F.coalesce("tick", F.unix_millis("at") / live.TICK).cast("long")

    def made(x):
        d = x.withColumn("tick", tick).drop("at")
        flat = d.select("camera", "tick", "det", "label", "score", *[F.col(f"box.{c}").alias(c) for c in "ltrb"]).withColumn("at", F.timestamp_millis(F.col("tick") * live.TICK))
        return live.on_stream(flat, "camera", live.Follow(), "camera long, tick long, det int, track long, sightings long", "60 seconds")

    got = live.to_its_end(made, s, "at").filter("camera IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == want and len(want) == len(rows)


def test_tracks_of_the_table_on_a_stream(spark, small):
    from recollect.plans.streams import numbered_detections

    rows = numbered_detections(spark, small, False).collect()
    want = []
    for camera in {r.camera for r in rows}:
        t, at, mine = tracker.Tracker(), 0, [r for r in rows if r.camera == camera]
        for now in sorted({r.tick for r in mine}):
            while at < now - 1:
                at += 1
                t.update([], at)
            at = now
            frame = sorted((r for r in mine if r.tick == now), key=lambda r: (r.det, r.label, r.score))
            found = t.update([{"label": r.label, "score": r.score, "box": tuple(r.box)} for r in frame], now)
            want += [(camera, now, r.det, track, n) for r, (track, n) in zip(frame, found, strict=True)]
    for name in ("trk_numbered", "stream_tracks"):
        assert sorted(map(tuple, registry.queries()[name](spark, small).collect())) == sorted(want)


def plain_speech(chunks, loud, faint, silence, least, longest):
    out, now = [], None
    for at, level in chunks:
        if level is None or level < faint:
            continue
        if now and at - now[1] <= silence:
            if at - now[0] < longest:
                now = [now[0], at, now[2] + 1]
                continue
            out, now = [*out, now], [at, at, 1]
        else:
            out, now = out + ([now] if now else []), [at, at, 1] if level >= loud else None
    return [tuple(x) for x in out + ([now] if now else []) if x[1] - x[0] >= least]


def test_segments_of_batches(spark):
    rng, rows, at = random.Random(7), [], 1_000_000
    for k in range(600):
        at += rng.choice([20, 60, 90, 90, 400, 700])
        rows.append((k % 2, at, k, rng.choice([None, 0.1, 0.35, 0.35, 0.6])))
    want = sorted((key, *x) for key in (0, 1) for x in plain_speech([(r[1], r[3]) for r in rows if r[0] == key], 0.5, 0.3, 500, 250, 3000))
    limits = {"silence_ms": 500, "least_ms": 250, "longest_ms": 3000}
    batch = live.segments_batch(spark.createDataFrame(rows, "key long, at_ms long, event_id long, level double"), 0.5, 0.3, **limits)
    assert sorted(map(tuple, batch.collect())) == want and max(x[2] - x[1] for x in want) <= 3000 and len(want) > 20
    stream = in_files(spark, rows, "key long, at_ms long, event_id long, level double", [100, 101, 350])
    stream = stream.select("key", "event_id", "level", F.timestamp_millis("at_ms").alias("at"))
    got = live.to_its_end(lambda s: live.segments_stream(s, 0.5, 0.3, **limits), stream, "at")
    assert sorted(map(tuple, got.collect())) == want


def test_legacy_gate_moves_its_baseline_on_accepting_alone():
    gate = live.LegacyGate()
    frame = lambda one, at, v: type("F", (), {"id": one, "at_ms": at, "grid": [v] * 4})()
    taken = [bool(gate.step(frame(k, at, v))) for k, (at, v) in enumerate([(0, 0.0), (2999, 1.0), (3000, 0.1), (6000, 0.15), (9000, 0.2), (21_000, 0.2), (24_000, 0.3)])]
    # a first one, one too soon, two that are alike, one just different enough, one overdue, one alike
    assert taken == [True, False, False, True, False, True, False]


def test_nearest_frame_of_two_streams_in_batches(spark):
    rng = random.Random(5)
    heard = [(k, 1_000_000 + rng.randrange(0, 4_000_000)) for k in range(60)]
    frames = [(k, 1_000_000 + rng.randrange(0, 4_000_000)) for k in range(80)]
    heard.sort(key=lambda r: r[1])
    frames.sort(key=lambda r: r[1])
    frames += [(900, heard[0][1] + 7), (901, heard[0][1] - 7)]  # equally near: the earlier one
    a, b = spark.createDataFrame(heard, "a_id long, a_ts long"), spark.createDataFrame(frames, "b_id long, b_ts long")
    want = sorted(map(tuple, intervals.nearest(a, b, 30_000).collect()), key=str)
    got = live.nearest_to_its_end(in_files(spark, heard, "a_id long, a_ts long", [20, 41]), in_files(spark, frames, "b_id long, b_ts long", [30, 31]), 30_000)
    got = sorted(map(tuple, got.select("a_id", "a_ts", "b_id", "b_ts").collect()), key=str)
    assert got == want and any(r[2] is None for r in want) and any(r[2] == 901 for r in want)


def test_rows_wait_packed_and_keys_share_a_bucket(spark):
    """A value of the state for each batch of rows, and a key of the state for each bucket: either grew with the rows or keys before."""
    schema = live.to_arrow_schema(live.StructType.fromDDL("at_ms long, id long, grid array<double>"))
    rows = pd.DataFrame({"at_ms": [1, 2], "id": pd.array([None, 2**53 + 1], "Int64"), "grid": [[0.5], None]})
    back = live.pa.ipc.open_stream(live.packed(rows, schema)).read_all()
    assert back.to_pylist() == [{"at_ms": 1, "id": None, "grid": [0.5]}, {"at_ms": 2, "id": 2**53 + 1, "grid": None}]
    many = [(k, 1000 * k + t + 1, 2 * k + t, "ready" if t == 0 else "record") for k in range(2 * live.BUCKETS) for t in (0, 1)]
    stream = in_files(spark, many, "key long, at_ms long, event_id long, event string", [len(many) // 2 + 1])
    stream = stream.select("key", "event_id", "event", F.timestamp_millis("at_ms").alias("at"))
    moves = {"Loading/ready": "Idle", "Idle/record": "Recording"}
    buckets = []
    on_stream = live.on_stream

    def watched(rows, key, *rest):
        buckets.append(key)
        return on_stream(rows, key, *rest)

    live.on_stream = watched
    try:
        got = live.to_its_end(lambda s: live.states_stream(s, moves, "Loading"), stream, "at")
    finally:
        live.on_stream = on_stream
    assert sorted(map(tuple, got.collect())) == sorted((k, e, moves["Loading/ready"] if x == "ready" else "Recording") for k, _, e, x in many) and buckets == ["bucket"]


class One:
    """A value of the state of one key, in memory."""

    has = None
    exists = lambda self: self.has is not None
    get = lambda self: self.has
    update = lambda self, value: setattr(self, "has", value)


class Map(dict):
    exists = lambda self: bool(self)
    iterator = lambda self: iter(list(self.items()))
    removeKey = dict.pop
    getValue = dict.__getitem__
    updateValue = dict.__setitem__


class Handle:
    def __init__(self):
        self.timers = set()
        self.registerTimer = self.timers.add
        self.getValueState = lambda *_: One()
        self.getMapState = lambda *_: Map()


def test_a_long_history_is_followed_a_part_at_a_time(spark, monkeypatch):
    """All rows of a camera were taken up at once, each through Python several times."""
    monkeypatch.setattr(live, "ORDERED", 60)
    monkeypatch.setattr(live, "PACKED", 8)
    rng, rows, tick = random.Random(11), [], 1
    for _ in range(900):
        tick += rng.choice([1, 1, 1, 1, 2, 15, 16, 17, 18])
        for det in range(rng.randrange(1, 4)):
            left = rng.choice([0.0, 1.0, 30.0])
            rows.append((tick, det, rng.choice(["cup", "dog", None]), rng.random(), left, 0.0, left + 10, 10.0))
    plain, want = tracker.Tracker(), []
    for now in sorted({r[0] for r in rows}):
        frame = [r for r in rows if r[0] == now]
        found = plain.update([{"label": r[2], "score": r[3], "box": r[4:]} for r in frame], now)
        want += [(7, now, r[1], *x) for r, x in zip(frame, found, strict=True)]
    follow, handle, sizes, got = live.Follow(), Handle(), [], []
    follow.arrow = live.to_arrow_schema(live.StructType.fromDDL(follow.schema))
    follow.init(handle)
    took = tracker.Frames.take
    monkeypatch.setattr(tracker.Frames, "take", lambda self, tick, *rest: (sizes.append(len(tick)), took(self, tick, *rest))[1])

    def packed(some):
        return pd.DataFrame({"rows": [live.packed(pd.DataFrame([(1000 * r[0], *r) for r in some[k : k + 25]], columns=follow.arrow.names), follow.arrow) for k in range(0, len(some), 25)]})

    def passes(watermark):
        clock = type("", (), {"getCurrentWatermarkInMs": lambda self: watermark})()
        for at in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(at)
            got.extend(tuple(r) for pdf in follow.handleExpiredTimer((7,), clock, None) for r in pdf.itertuples(index=False))

    half = len(rows) // 2
    for a, b in ((0, half), (half, len(rows))):
        some = rows[a:b]
        rng.shuffle(some)
        list(follow.handleInputRows((7,), iter([packed(some[:200]), packed(some[200:])]), None))
        passes(1000 * rows[half][0] - 1 if a == 0 else 10**9)
        late = (1, 0, "cup", 0.5, 0.0, 0.0, 10.0, 10.0)
        list(follow.handleInputRows((7,), iter([packed([late])]), None))  # the camera has been followed past it
    passes(10**9)
    assert sorted(got) == sorted(want) and len(want) > 1500
    assert max(sizes) < 500 and len(sizes) > 8 and not follow.waiting.exists()


def test_frames_together_as_one_by_one():
    for seed in range(20):
        rng, rows, tick = random.Random(seed), [], 0
        for _ in range(150):
            tick += rng.choice([1, 1, 1, 1, 2, 9, 15, 16, 17, 18])
            for _ in range(rng.randrange(1, 6)):
                # few places, so that many overlaps are equal
                left, top, wide = rng.choice([0.0, 1.0, 2.0, 30.0]), rng.choice([0.0, 1.0]), rng.choice([10.0, 10.0, 10.0, 0.0, float("nan")])
                rows.append((tick, rng.choice(["a", "b", None]), rng.random(), (left, top, left + wide, top + 10.0)))
        plain, want, got = tracker.Tracker(), [], []
        for now in sorted({r[0] for r in rows}):
            want += plain.update([{"label": r[1], "score": r[2], "box": r[3]} for r in rows if r[0] == now], now)
        together, labels = tracker.Frames(0, []), ["b", None, "a"]
        for since in range(0, tick + 1, 100):
            some = [r for r in rows if since <= r[0] < since + 100]
            columns = [np.array(c) for c in ([r[0] for r in some], [labels.index(r[1]) for r in some])]
            if some:
                track, sightings = together.take(*columns, labels, np.array([r[2] for r in some]), np.array([r[3] for r in some]).T)
                got += zip(track.tolist(), sightings.tolist(), strict=True)
        assert got == want and repr(together.tracks) == repr([{k: t[k] for k in together.tracks[0]} for t in plain.tracks])


def test_rows_reach_the_state_packed(spark):
    """Spark hands the rows of a key to Python one by one, so some thousands come as one."""
    rows = [(k % 3, 10 + k // 30, k % 30, "cup", 0.9, (float(20 * (k % 30)), 0.0, float(20 * (k % 30) + 10), 10.0)) for k in range(9000)]
    schema = f"camera long, tick long, det int, label string, score double, {BOX}"
    seen = []
    of_stream = live.on_stream

    def watched(*args):
        seen.append(of_stream(*args)._jdf.queryExecution().analyzed().toString().splitlines())
        return of_stream(*args)

    stream = in_files(spark, rows, schema, [4000]).withColumn("at", F.timestamp_millis(F.col("tick") * live.TICK))
    live.on_stream = watched
    try:
        got = live.to_its_end(lambda s: live.tracks_stream(s.withColumn("tick", F.coalesce("tick", F.unix_millis("at") / live.TICK).cast("long")).drop("at")), stream, "at")
    finally:
        live.on_stream = of_stream
    got = got.filter("camera IS NOT NULL")
    assert got.count() == len(rows) and got.agg(F.max("track"), F.max("sightings")).first()[:] == (10, 300)
    state = next(k for k, line in enumerate(seen[0]) if "TransformWithState" in line)
    assert any("MapInArrow" in line and "rows" in line for line in seen[0][state:])
