"""Queries on streams: run on the files there are, and their batch twins (SRC4, SRC5, STR2-STR5, STR8, STR11, STR14, STR15)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import sync
from ..sources import moments as M
from ..streaming import capture, live, run, tracker
from .core import query, with_points
from .perception import detections, grid_column
from .retrieval import NEAREST


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; a table of a single file is one of its folder's files."""
    path = f"{sf_dir}/{name}.parquet"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    alone = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if alone else reader.parquet(path)


def frames(spark: SparkSession, sf_dir: str, streaming: bool) -> DataFrame:
    """Vectors as the frames of a camera for each user, a fifth of a second for each id."""
    e = stream(spark, sf_dir, "embeddings") if streaming else M.table(spark, sf_dir, "embeddings")
    g = grid_column()
    return e.select(
        (F.col("vec_id") % 5).alias("camera"), F.col("vec_id").alias("id"), (F.col("vec_id") * 331).alias("ts"), g.alias("grid"), F.col("embedding").cast("array<double>").alias("vec"),
        G.sharpness(g, 8).alias("sharp"),
    )


@query("stream_capture_gate")
def stream_capture_gate(spark, sf_dir):
    """The capture automaton on a stream; tests hold it against the batch form and a plain loop."""
    return run.available_now(capture.moments_stream(frames(spark, sf_dir, True), 0.99, 0.90))


@query("batch_capture_gate")
def batch_capture_gate(spark, sf_dir):
    return capture.moments_batch(frames(spark, sf_dir, False), 0.99, 0.90)


SEGMENTS = """WITH c AS (SELECT user_id, ts FROM events WHERE value > 20), n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM n)
SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS chunks FROM r GROUP BY user_id, run HAVING count(*) >= 2"""


@query("batch_session_segments", SEGMENTS)
def batch_session_segments(spark, sf_dir):
    """Voiced stretches: sessions of loud events, those of a single event left out (STR8)."""
    e = M.table(spark, sf_dir, "events").filter("value > 20")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min(M.epoch_ms(F.col("ts"))).alias("start_ms"), F.max(M.epoch_ms(F.col("ts"))).alias("last_ms"), F.count("*").alias("chunks"))
    return s.filter("chunks >= 2").select("user_id", "start_ms", "last_ms", "chunks")


@query("stream_session_segments", SEGMENTS)
def stream_session_segments(spark, sf_dir):
    """The same on a stream: a session is given out when the watermark has passed it, and at the end of the input, which a last event marks."""
    t = M.epoch_ms(F.col("ts"))
    voiced = stream(spark, sf_dir, "events").filter("value > 20").select("user_id", F.col("ts").cast("timestamp").alias("at"), t.alias("t"))
    ends = run.shared_folder(spark)
    end = spark.createDataFrame([(None, datetime(2200, 1, 1), None)], voiced.schema)
    end.limit(0).write.parquet(ends)
    e = voiced.unionByName(spark.readStream.schema(voiced.schema).parquet(ends)).withWatermark("at", "1 hour")
    s = e.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.min("t").alias("start_ms"), F.max("t").alias("last_ms"), F.count("*").alias("chunks"))
    # the end's own session stays open, and needs no filter, which would keep it from the watermark
    out = s.filter("chunks >= 2").select("user_id", "start_ms", "last_ms", "chunks")
    return run.available_now(out, then=lambda: end.write.mode("append").parquet(ends))


@query("stream_sync", with_points("SELECT id, timestamp_ms, coalesce(synced, false) OR type = 'frame' AS synced FROM points"))
def stream_sync(spark, sf_dir):
    """After all passes of the sync loop: every unsynced frame was sent and then flagged, nothing else changed (STR11)."""
    p = M.points(spark, sf_dir).select("id", "type", "timestamp_ms", "synced")
    sent = p.filter((F.col("type") == "frame") & ~F.coalesce("synced", F.lit(False)))
    flagged = sync.mark_synced(p, sent.select("id"))
    return flagged.select("id", "timestamp_ms", F.coalesce("synced", F.lit(False)).alias("synced"))


@query("stream_late_generation", "SELECT event_id, user_id FROM (SELECT *, floor(event_id / 1000) AS gen, max(floor(event_id / 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS now FROM events) WHERE gen = now")
def stream_late_generation(spark, sf_dir):
    """Frames of an older session than the newest seen are dropped (STR3)."""
    gen = F.floor(F.col("event_id") / 1000)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = M.table(spark, sf_dir, "events").withColumn("gen", gen)
    return e.withColumn("now", F.max("gen").over(w)).filter("gen = now").select("event_id", "user_id")


#: Legal moves of the app's state machine; an event that fits none changes nothing (STR15).
MOVES = {
    ("Loading", "ready"): "Idle", ("Idle", "record"): "Recording", ("Recording", "stop"): "Idle", ("Idle", "listen"): "Listening", ("Listening", "heard"): "Processing",
    ("Processing", "found"): "Results", ("Results", "dismiss"): "Idle", ("Processing", "fail"): "Error", ("Error", "dismiss"): "Idle", ("Listening", "cancel"): "Idle",
}


@query("app_states")
def app_states(spark, sf_dir):
    """The state after each conversation's turns, folded in order (STR15)."""
    names = ["ready", "listen", "heard", "found", "dismiss", "record", "stop", "cancel", "fail"]
    event = F.get(F.array(*map(F.lit, names)), (F.length("text") % len(names)).cast("int"))
    c = M.table(spark, sf_dir, "conversations").select("conv_id", "turn", event.alias("event"))
    moves = F.create_map(*[x for (a, b), to in MOVES.items() for x in (F.lit(f"{a}/{b}"), F.lit(to))])
    events = F.transform(F.array_sort(F.collect_list(F.struct("turn", "event"))), lambda x: x["event"])
    fold = lambda e: F.aggregate(e, F.lit("Loading"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat_ws("/", s, x)), s))
    return c.groupBy("conv_id").agg(events.alias("e")).select("conv_id", fold(F.col("e")).alias("state"))


EVENTS = ["ready", "listen", "heard", "found", "dismiss", "record", "stop", "cancel", "fail"]

APP = f"""WITH RECURSIVE moves AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{x}', '{to}')" for (a, x), to in MOVES.items())}) m(a, event, b)),
e AS (SELECT user_id AS key, event_id, {EVENTS}[1 + event_id * 7 % 9] AS event, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
s AS (
  SELECT key, 0::BIGINT AS k, 'Loading' AS state, NULL::BIGINT AS event_id, false AS moved FROM (SELECT DISTINCT key FROM e)
  UNION ALL
  SELECT e.key, e.k, coalesce(m.b, s.state), e.event_id, m.b IS NOT NULL FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1 LEFT JOIN moves m ON m.a = s.state AND m.event = e.event
)
SELECT key, event_id, state FROM s WHERE moved"""


def app_events(spark: SparkSession, sf_dir: str, streaming: bool) -> DataFrame:
    e = stream(spark, sf_dir, "events") if streaming else M.table(spark, sf_dir, "events")
    event = F.get(F.array(*map(F.lit, EVENTS)), (F.col("event_id") * 7 % 9).cast("int"))
    rows = e.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), event.alias("event"), F.col("ts").cast("timestamp").alias("at"))
    return rows if streaming else rows.withColumn("at_ms", F.unix_millis("at")).drop("at")


NAMED = {f"{a}/{x}": to for (a, x), to in MOVES.items()}


@query("batch_app_states", APP)
def batch_app_states(spark, sf_dir):
    """Every move of each user's app (STR15)."""
    return live.states_batch(app_events(spark, sf_dir, False), NAMED, "Loading")


@query("stream_app_states", APP)
def stream_app_states(spark, sf_dir):
    """The same on a stream, the state kept between its batches (STR15)."""
    return live.to_its_end(lambda s: live.states_stream(s, NAMED, "Loading"), app_events(spark, sf_dir, True), "at")


@query(
    "app_button",
    "SELECT event_id, CASE WHEN held < 3600000 THEN 'tap' ELSE 'long' END AS press FROM (SELECT event_id, epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 AS held FROM events) WHERE held > 300000",
)
def app_button(spark, sf_dir):
    """Presses: releases within a grace after the last are ignored, short ones are taps (STR16)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = M.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", M.epoch_ms(F.col("ts")).alias("t"))
    held = e.withColumn("held", F.col("t") - F.lag("t").over(w)).filter("held > 300000")
    return held.select("event_id", F.when(F.col("held") < 3_600_000, "tap").otherwise("long").alias("press"))


# --- automata over event time


def speech(spark: SparkSession, sf_dir: str, streaming: bool) -> DataFrame:
    """Events as the chunks of a microphone for each user, their value the loudness."""
    e = stream(spark, sf_dir, "events") if streaming else M.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("level"), F.col("ts").cast("timestamp").alias("at"))
    return rows if streaming else rows.withColumn("at_ms", F.unix_millis("at")).drop("at")


#: Loudness that opens and that keeps a segment open; silence that closes one, the least and the longest duration (in milliseconds).
LOUD, FAINT, LIMITS = 60.0, 20.0, {"silence_ms": 6 * 3_600_000, "least_ms": 3_600_000, "longest_ms": 24 * 3_600_000}

SPEECH_SEGMENTS = f"""WITH RECURSIVE f AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS t, value >= {LOUD} AS loud, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events WHERE value >= {FAINT}),
s AS (
  SELECT key, k, t, loud AS open, t AS start_ms, 1 AS seg FROM f WHERE k = 1
  UNION ALL
  SELECT key, k, t, open, CASE WHEN stays THEN start_ms ELSE t END, CASE WHEN stays THEN seg ELSE seg + 1 END FROM (
    SELECT f.key, f.k, f.t, s.start_ms, s.seg, s.open AND f.t - s.t <= {LIMITS['silence_ms']} AND f.t - s.start_ms < {LIMITS['longest_ms']} AS stays,
      (s.open AND f.t - s.t <= {LIMITS['silence_ms']}) OR f.loud AS open
    FROM s JOIN f ON f.key = s.key AND f.k = s.k + 1)
)
SELECT key, min(t) AS start_ms, max(t) AS last_ms, count(*) AS chunks FROM s WHERE open GROUP BY key, seg HAVING max(t) - min(t) >= {LIMITS['least_ms']}"""


@query("batch_speech_segments", SPEECH_SEGMENTS)
def batch_speech_segments(spark, sf_dir):
    """Segments with a longest and a least duration, by two levels of loudness (STR8)."""
    return live.segments_batch(speech(spark, sf_dir, False), LOUD, FAINT, **LIMITS)


@query("stream_speech_segments", SPEECH_SEGMENTS)
def stream_speech_segments(spark, sf_dir):
    """The same on a stream, closed by timers (STR8, SRC5)."""
    return live.to_its_end(lambda s: live.segments_stream(s, LOUD, FAINT, **LIMITS), speech(spark, sf_dir, True), "at")


def legacy_frames(spark: SparkSession, sf_dir: str, streaming: bool) -> DataFrame:
    e = stream(spark, sf_dir, "embeddings") if streaming else M.table(spark, sf_dir, "embeddings")
    rows = e.select((F.col("vec_id") % 5).alias("camera"), F.col("vec_id").alias("id"), grid_column().alias("grid"), F.timestamp_millis(F.col("vec_id") * 331 + 1000).alias("at"))
    return rows if streaming else rows.withColumn("at_ms", F.unix_millis("at")).drop("at")


#: Grids of the vectors are more alike than pictures, so the gate's bound is nearer to 1.
ALIKE = 0.93

LEGACY_GATE = f"""WITH RECURSIVE f AS (SELECT vec_id % 5 AS camera, vec_id AS id, vec_id * 331 + 1000 AS at_ms, list_transform(embedding::DOUBLE[], lambda x: (x + 1.0) / 2) AS g FROM embeddings),
s AS (
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY camera ORDER BY at_ms, id) = 1
  UNION ALL
  SELECT f.* FROM s JOIN f ON f.camera = s.camera AND f.id = (SELECT arg_min(n.id, (n.at_ms, n.id)) FROM f n WHERE n.camera = s.camera AND (n.at_ms, n.id) > (s.at_ms, s.id) AND n.at_ms - s.at_ms >= 3000
    AND (round(1 - list_sum(list_transform(range(1, 65), lambda i: abs(n.g[i] - s.g[i]))) / 64, 6) <= {ALIKE} OR n.at_ms - s.at_ms >= 12000))
)
SELECT camera, id, at_ms FROM s"""


@query("batch_legacy_gate", LEGACY_GATE)
def batch_legacy_gate(spark, sf_dir):
    """Frames that the older gate accepts (STR4, SRC4)."""
    return live.accepted_batch(legacy_frames(spark, sf_dir, False), alike=ALIKE)


@query("stream_legacy_gate", LEGACY_GATE)
def stream_legacy_gate(spark, sf_dir):
    """The same on a stream (STR4, SRC4)."""
    return live.to_its_end(lambda s: live.accepted_stream(s, alike=ALIKE), legacy_frames(spark, sf_dir, True), "at")


def numbered_detections(spark: SparkSession, sf_dir: str, streaming: bool) -> DataFrame:
    """Lines of orders as detections of numbered frames."""
    li = stream(spark, sf_dir, "lineitem") if streaming else None
    d = detections(spark, sf_dir, li)
    return d.select((F.col("frame") % 97).cast("long").alias("camera"), F.expr("frame div 97 + 1").alias("tick"), F.col("det").cast("int").alias("det"), "label", "score", "box")


@query("trk_numbered")
def trk_numbered(spark, sf_dir):
    """Tracks over numbered frames, stretches apart followed by tasks of their own (STR5, JON9); tests hold it against a plain loop."""
    return tracker.tracked(numbered_detections(spark, sf_dir, False), numbered=True)


@query("stream_tracks")
def stream_tracks(spark, sf_dir):
    """The same on a stream: live tracks in a map for each camera, ended by timers (STR5, JON9)."""
    d = numbered_detections(spark, sf_dir, True).withColumn("at", F.timestamp_millis(F.col("tick") * live.TICK))
    # the last row's tick is the one that its time stands for
    tick = F.coalesce("tick", F.unix_millis("at") / live.TICK).cast("long")
    return live.to_its_end(lambda s: live.tracks_stream(s.withColumn("tick", tick).drop("at")), d, "at").filter("camera IS NOT NULL")


@query("stream_nearest_frame", NEAREST)
def stream_nearest_frame(spark, sf_dir):
    """For each transcript the nearest frame, both being streams (STR9, JON7): a join of intervals that forgets what can't meet any more."""
    e, v = stream(spark, sf_dir, "embeddings"), M.table(spark, sf_dir, "events").select("event_id", M.epoch_ms(F.col("ts")).alias("t"))
    docs = M.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    # a point's time is its moment's, an event of the table
    timed = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") - F.col("vec_id") % 5).alias("event_id")).join(v, "event_id")
    heard = timed.filter("id % 5 = 4").join(docs, F.col("id") == F.col("doc_id")).select(F.col("id").alias("a_id"), F.floor((F.col("t") + F.col("t") + F.col("n_chars") * 10) / 2).alias("a_ts"))
    frames = timed.filter("id % 5 = 0").select(F.col("id").alias("b_id"), F.col("t").alias("b_ts"))
    out = live.nearest_to_its_end(heard, frames, 30_000)
    return out.select(F.col("a_id").alias("transcript"), F.col("b_id").alias("frame"))
