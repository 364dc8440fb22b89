"""Queries on stores, files, snapshots, sinks and lanes: what is written is read back (SRC, SNK, STR, EVL, FUS18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tokenizers
from ..functions import vectors as V
from ..operators import scan, sync
from ..sources import encoders, legacy, reports, store
from ..sources import moments as M
from ..streaming import branch, push, run
from .collection import points
from .core import query, with_points
from .searcher import repository_search
from .streams import stream

SIZE = 64


def stored(spark: SparkSession, sf_dir: str, kinds: str = "type = 'frame'") -> store.MomentStore:
    """A new store with points of the collection."""
    s = store.MomentStore(spark, run.shared_folder(spark), SIZE, SIZE)
    p = points(spark, sf_dir).filter(kinds)
    rows = p.select(
        F.col("id").cast("string").alias("id"), F.col("moment_id").cast("string").alias("moment_id"), "type", "episode_id", "timestamp_ms", "t_end_ms", "thumb_path", "bbox", "label",
        "yolo_conf", "verify_cos", F.coalesce("synced", F.lit(False)).alias("synced"), F.col("clip").cast("array<float>").alias("clip"),
    )
    s.store_moments(rows.filter("type = 'frame'").drop("type"))
    s.store_regions(rows.filter("type = 'region'").drop("type"))
    return s


@query(
    "src_label_vectors",
    f"""SELECT 'l' || label AS label, {SIZE}::BIGINT AS size, round(list_sum(arg_max(embedding, vec_id)::DOUBLE[]), 4) AS total FROM embeddings WHERE vec_id % 3 <> 1 GROUP BY label""",
)
def src_label_vectors(spark, sf_dir):
    """Lines of label and numbers; lines with a number too few or with a word are left out, a later line wins (SRC6)."""
    e = M.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<string>").alias("v"))
    good = F.array_join("v", ",")
    body = F.when(F.col("vec_id") % 3 != 1, good).when(F.col("vec_id") % 2 == 0, F.array_join(F.slice("v", 1, SIZE - 1), ",")).otherwise(F.concat(good, F.lit(",x")))
    place = run.shared_folder(spark)
    # one file, as the cache of labels is
    e.orderBy("vec_id").select(F.concat(F.lit("l"), "label", F.lit("\t"), body).alias("value")).coalesce(1).write.text(place)
    v = M.label_vectors(spark, place, SIZE)
    return v.select("label", F.size("vector").cast("long").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


STORE_STEPS = """SELECT 'stored ' || type AS step, count(*) AS n FROM points WHERE type IN ('frame', 'region') GROUP BY type
UNION ALL SELECT 'upserted ' || type, count(*) FROM points WHERE type IN ('frame', 'region') GROUP BY type
UNION ALL SELECT 'relabelled', count(*) FROM points WHERE type = 'frame' AND id % 10 = 0 UNION ALL SELECT 'deleted', 0"""


@query("snk_store_steps", with_points(STORE_STEPS))
def snk_store_steps(spark, sf_dir):
    """A store is filled, opened again, some of its points are replaced, all are deleted (SRC1, SRC3, SNK4, SNK7)."""
    first = stored(spark, sf_dir, "type IN ('frame', 'region')")
    s = store.MomentStore(spark, first.root, SIZE, SIZE)
    count = lambda name: s.points().groupBy("type").count().select(F.concat(F.lit(f"{name} "), "type").alias("step"), F.col("count").alias("n"))
    # written down step by step, as the next step changes what is read
    rows = count("stored").collect()
    s.upsert(s.points().filter("type = 'frame' AND id % 10 = 0").withColumn("label", F.lit("again")))
    rows += count("upserted").collect() + [("relabelled", s.points().filter("label = 'again'").count())]
    s.delete_all()
    return spark.createDataFrame([*map(tuple, rows), ("deleted", s.count())], "step string, n long")


@query("rel_count_or_none", with_points("SELECT * FROM (VALUES ('nothing open', 0::BIGINT), ('failed', NULL)) v(state, n) UNION ALL SELECT 'open', count(*) FROM points WHERE type = 'frame'"))
def rel_count_or_none(spark, sf_dir):
    """0 without a store, null where counting fails (REL3)."""

    class Broken(store.MomentStore):
        def count(self):
            raise OSError("the storage is away")

    s = stored(spark, sf_dir)
    broken = Broken(spark, s.root, SIZE, SIZE)
    rows = [("nothing open", store.count_or_none(None)), ("failed", store.count_or_none(broken)), ("open", store.count_or_none(s))]
    return spark.createDataFrame(rows, "state string, n long")


REPOSITORY = """, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
f AS (SELECT id, timestamp_ms, round(list_cosine_similarity(clip, q), 6) AS score FROM points, q WHERE type = 'frame')
SELECT 'vector' AS way, id FROM (SELECT id FROM f ORDER BY score DESC, id LIMIT 20) UNION ALL SELECT 'time', id FROM (SELECT id FROM f ORDER BY timestamp_ms DESC, id LIMIT 50)"""


@query("flt_repository", with_points(REPOSITORY.replace(", id LIMIT", ", id::VARCHAR LIMIT").replace("SELECT 'vector' AS way, id", "SELECT 'vector' AS way, id::VARCHAR AS id").replace("'time', id FROM", "'time', id::VARCHAR FROM")))
def flt_repository(spark, sf_dir):
    """By vector where there are words and an encoder, by time where there are none (FUS18)."""
    s = stored(spark, sf_dir)
    q = M.table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding
    ways = [("vector", repository_search(s, "a phrase", lambda _: [q])), ("time", repository_search(s, " ", lambda _: [q]))]
    found = [df.select(F.lit(way).alias("way"), "id") for way, df in ways]
    return found[0].unionByName(found[1])


@query("stream_sync_passes", with_points("SELECT ceil(count(*) / 100.0)::BIGINT AS passes, count(*) AS sent, count(*) AS hub, 0::BIGINT AS unsynced FROM points WHERE type = 'frame' AND NOT coalesce(synced, false)"))
def stream_sync_passes(spark, sf_dir):
    """Passes of a hundred until every frame is at the hub and flagged; a pass whose sending failed changes no flag (STR11)."""
    s, hub = stored(spark, sf_dir), store.MomentStore(spark, run.shared_folder(spark), SIZE, SIZE)

    class Away(store.MomentStore):
        def upsert(self, rows):
            raise OSError("the hub is away")

    try:
        store.sync_once(s, Away(spark, hub.root, SIZE, SIZE))
    except OSError:
        pass  # the next pass sends the same frames again
    passes, sent = store.sync_all(s, hub)
    left = s.points().filter("type = 'frame' AND NOT synced").count()
    return spark.createDataFrame([(passes, sent, hub.count(), left)], "passes long, sent long, hub long, unsynced long")


SNAPSHOTS = """SELECT * FROM (SELECT 'first' AS step, 'loaded' AS state, count(*) AS n, count(*) AS loaded FROM points UNION ALL SELECT 'empty', 'empty', 0, count(*) FROM points
UNION ALL SELECT 'away', 'unreachable', NULL, count(*) FROM points UNION ALL SELECT 'second', 'loaded', count(*) FILTER (type = 'frame'), count(*) FILTER (type = 'frame') FROM points
UNION ALL SELECT 'deleted', 'true', NULL, count(*) FILTER (type = 'frame') FROM points)"""


@query("src_snapshots", with_points(SNAPSHOTS))
def src_snapshots(spark, sf_dir):
    """Pulls that work, that find nothing, and that fail; the old snapshot is deleted after the new one is current (SRC2, SRC10, STR12, STR13)."""
    s, p = sync.Snapshots(spark, run.shared_folder(spark)), points(spark, sf_dir).select("id", "type")
    sources = {"first": p, "empty": p.limit(0), "away": None, "second": p.filter("type = 'frame'")}
    rows, first = [], None
    for step, df in sources.items():
        place = run.shared_folder(spark)
        if df is not None:
            df.write.parquet(place)
        state, n = s.pull(place)
        rows.append((step, state.split(":")[0], n, s.load().count()))
        first = first or s.current()
    rows.append(("deleted", str(s.delete(first)).lower(), None, s.load().count()))
    return spark.createDataFrame(rows, "step string, state string, n long, loaded long")


EXTRACTED = """SELECT 1::BIGINT AS time, true AS copied, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes FROM documents UNION ALL SELECT 2, false, sum(length(doc_id::VARCHAR) + 1) FROM documents
UNION ALL SELECT 3, true, sum(length(o_orderkey::VARCHAR) + 1) FROM orders"""


@query("snk_extracted", EXTRACTED)
def snk_extracted(spark, sf_dir):
    """An asset, a file of ids, is copied once, and again when its size has changed (SRC11)."""
    s, asset = sync.Snapshots(spark, run.shared_folder(spark)), run.shared_folder(spark)
    rows = []
    for time, (table, column) in ((1, ("documents", "doc_id")), (2, (None, None)), (3, ("orders", "o_orderkey"))):
        if table:
            M.table(spark, sf_dir, table).select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(asset)  # an asset is one file
        part = spark.read.format("binaryFile").load(f"{asset}/part-*").select("path").first().path
        rows.append((time, s.extract(part, "asset"), s.size(f"{s.root}/asset")))
    return spark.createDataFrame(rows, "time long, copied boolean, bytes long")


@query("snk_report_csv", "SELECT 'insert' AS op, event_id AS run, round(value, 2) AS ms FROM events WHERE user_id % 10 = 0")
def snk_report_csv(spark, sf_dir):
    """Times of runs, written as a report and read again (SNK11)."""
    place = run.shared_folder(spark)
    e = M.table(spark, sf_dir, "events").filter("user_id % 10 = 0").select(F.lit("insert").alias("op"), F.col("event_id").alias("run"), F.round("value", 2).alias("ms"))
    reports.write_csv(e, place)
    return spark.read.option("header", True).schema("op string, run long, ms double").csv(place)


@query(
    "eval_given_up",
    "SELECT user_id AS key, min(event_id) AS at FROM (SELECT user_id, event_id, value < 40 AND lag(value) OVER (PARTITION BY user_id ORDER BY event_id) < 40 AS stop FROM events) WHERE stop GROUP BY user_id",
)
def eval_given_up(spark, sf_dir):
    """Where runs are given up: the second slow chunk in a row (EVL5)."""
    return reports.slow_runs(M.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("chunk"), F.col("value").alias("rate")), 40.0)


WORKLOAD = f"""WITH v AS (SELECT event_id AS id, event_id % 100 AS c, list_transform(range(1, {SIZE + 1}), lambda i: cos((event_id % 100 + 1) * (0.7 + i * i % 13)) + 0.05 * sin((event_id + 1) * (0.3 + i % 7))) AS x,
  list_transform(range(1, {SIZE + 1}), lambda i: cos((event_id % 100 + 1) * (0.7 + i * i % 13))) AS m FROM events),
s AS (SELECT id, list_cosine_similarity(x, m) AS near FROM v)
SELECT count(*) AS n, count(*) AS of_unit_length, count(*) FILTER (near > 0.95) AS near_their_centre, round(min(near), 6) AS furthest FROM s"""


@query("eval_workload", WORKLOAD)
def eval_workload(spark, sf_dir):
    """Vectors of a workload, one for each event: all of length one, each near one of a hundred centres (EVL3)."""
    w = reports.workload(M.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), SIZE, 100)
    length, near = V.dot(F.col("v"), F.col("v")), V.cosine(F.col("v"), F.col("centre"))
    return w.agg(F.count("*").alias("n"), F.count_if(F.abs(length - 1) < 1e-9).alias("of_unit_length"), F.count_if(near > 0.95).alias("near_their_centre"), F.round(F.min(near), 6).alias("furthest"))


@query("eval_timing", """SELECT op, s[len(s) // 2 + 1] AS median, s[len(s) * 9 // 10 + 1] AS p90, s[1] AS least, s[len(s)] AS most, round(list_avg(s), 6) AS mean
FROM (SELECT event_type AS op, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type)""")
def eval_timing(spark, sf_dir):
    """The statistics of each operation's runs: upper median, p90, least, most, mean (EVL4)."""
    e = M.table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("event_type").alias("op"), F.col("value").alias("ms"))
    return reports.timings(e)


@query("eval_reopened", with_points("SELECT count(*) AS stored, count(*) + count(*) FILTER (id % 10 = 0) AS reopened, count(*) FILTER (type = 'frame') + count(*) FILTER (type = 'frame' AND id % 10 = 0) AS frames FROM points WHERE type IN ('frame', 'region')"))
def eval_reopened(spark, sf_dir):
    """A store that is closed, opened again and given more has what both put there (EVL2)."""
    first = stored(spark, sf_dir, "type IN ('frame', 'region')")
    n = first.count()
    again = store.MomentStore(spark, first.root, SIZE, SIZE)
    again.upsert(again.points().filter("cast(id AS long) % 10 = 0").withColumn("id", F.concat(F.lit("more "), "id")))
    third = store.MomentStore(spark, first.root, SIZE, SIZE)
    return spark.createDataFrame([(n, third.count(), third.frame_count())], "stored long, reopened long, frames long")


@query("rel_disk_usage", "SELECT 'b32' AS namespace, sum(length(o_orderkey::VARCHAR) + 1)::BIGINT AS bytes FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b320', sum(length(o_orderkey::VARCHAR) + 1) FROM orders WHERE o_orderkey % 2 = 1")
def rel_disk_usage(spark, sf_dir):
    """Bytes of the files of each namespace, none of another whose name goes on (REL23)."""
    place = run.shared_folder(spark)
    keys = M.table(spark, sf_dir, "orders").select("o_orderkey")
    for namespace, odd in (("b32", 0), ("b320", 1)):
        keys.filter(F.col("o_orderkey") % 2 == odd).select(F.col("o_orderkey").cast("string").alias("value")).write.text(f"{place}/ns-{namespace}")
    usage = lambda n: reports.disk_usage(spark, place, n).select(F.lit(n).alias("namespace"), "bytes")
    return usage("b32").unionByName(usage("b320"))


@query(
    "src_encoded",
    "SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 'length' WHEN length(text) % 5 = 1 THEN 'number' ELSE 'sound' END AS state FROM conversations",
)
def src_encoded(spark, sf_dir):
    """Vectors of an encoder that sometimes fails: those of another length or with a number that isn't finite are told (SRC9)."""

    def encoder(texts: list[str]) -> list[list[float]]:
        return [[1.0] * (SIZE - (len(t) % 5 == 0)) if len(t) % 5 != 1 else [float("nan")] * SIZE for t in texts]

    c = encoders.encoded(M.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", encoder)
    state = F.when(encoders.sound(F.col("vector"), SIZE), "sound").when(F.size("vector") == SIZE, "number").otherwise("length")
    return c.select("conv_id", "turn", state.alias("state"))


@query("src_vocabulary", "SELECT 'w' || label AS token, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM embeddings)")
def src_vocabulary(spark, sf_dir):
    """A vocabulary of a token in each line, numbered by its lines, written to and read from the shared folder (SRC8)."""
    place = run.shared_folder(spark)
    labels = M.table(spark, sf_dir, "embeddings").select("label").distinct().orderBy("label")
    labels.select(F.concat(F.lit("w"), "label").alias("value")).coalesce(1).write.text(place)  # a vocabulary is one file
    return tokenizers.vocabulary_table(spark, f"{place}/part-*")


SOURCES = """SELECT 'camera' AS source, count(*) AS n FROM (SELECT user_id, epoch_us(ts) // 1000 AS ts FROM events WHERE event_type = 'view')
UNION ALL SELECT 'sound', count(*) FROM events WHERE value > 20"""


@query("src_streams", SOURCES.replace("event_type = 'view'", "event_id % 3 = 0"))
def src_streams(spark, sf_dir):
    """Files as the streams of a camera and of a microphone: frames as they come, chunks that are loud (SRC4, SRC5)."""
    frames = run.available_now(stream(spark, sf_dir, "events").filter("event_id % 3 = 0").select("user_id", M.epoch_ms(F.col("ts")).alias("ts")))
    sound = run.available_now(stream(spark, sf_dir, "events").filter("value > 20").select("user_id", "value"))
    count = lambda name, df: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"))
    return count("camera", frames).unionByName(count("sound", sound))


LEGACY = """SELECT id, 'image' AS type, 'pic/' || id || '.jpg' AS path, timestamp_ms AS start_ms, timestamp_ms AS end_ms, '' AS said FROM points WHERE type = 'frame'
UNION ALL SELECT id, 'text', '', timestamp_ms, timestamp_ms + 500, 'said "' || id || '"' FROM points WHERE type = 'ocr'"""


@query("snk_legacy_points", with_points(LEGACY))
def snk_legacy_points(spark, sf_dir):
    """Pictures and transcripts as points, and what their payloads say (SNK5)."""
    p = points(spark, sf_dir)
    images = p.filter("type = 'frame'").select("id", F.concat(F.lit("pic/"), "id", F.lit(".jpg")).alias("image_path"), F.col("clip").cast("array<float>").alias("clip"), "timestamp_ms")
    said = p.filter("type = 'ocr'").select(
        "id", F.concat(F.lit('said "'), "id", F.lit('"')).alias("transcript"), F.col("clip").cast("array<float>").alias("clip"), F.col("clip").cast("array<float>").alias("text_vec"),
        F.col("timestamp_ms").alias("t_start_ms"), (F.col("timestamp_ms") + 500).alias("t_end_ms"), F.lit("").alias("image_path"),
    )
    both = legacy.image_points(images).unionByName(legacy.transcript_points(said))
    field = lambda name, kind="string": F.get_json_object("payload", f"$.{name}").cast(kind)
    start = F.coalesce(field("t_start_ms", "long"), field("timestamp_ms", "long"))
    return both.select(
        "id", field("type").alias("type"), field("image_path").alias("path"), start.alias("start_ms"), F.coalesce(field("t_end_ms", "long"), start).alias("end_ms"),
        F.coalesce(field("transcript"), F.lit("")).alias("said"),
    )


@query("snk_thumb", "SELECT doc_id, CASE WHEN length(base64(encode(text))) <= 6144 THEN base64(encode(text)) ELSE '' END AS thumb FROM documents")
def snk_thumb(spark, sf_dir):
    """Bytes as text for a payload, none of more than 6144 characters (SNK13)."""
    return M.table(spark, sf_dir, "documents").select("doc_id", legacy.thumb_b64(F.encode("text", "UTF-8")).alias("thumb"))


LE = "unhex(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))"
WAV = f"""WITH d AS (SELECT doc_id, encode(text) AS pcm FROM documents), n AS (SELECT doc_id, pcm, printf('%08X', octet_length(pcm)) AS a, printf('%08X', octet_length(pcm) + 36) AS b FROM d)
SELECT doc_id, sha256(encode('RIFF') || {LE.replace('(h,', '(b,')} || encode('WAVEfmt ') || unhex('1000000001000100803E0000007D000002001000') || encode('data') || {LE.replace('(h,', '(a,')} || pcm) AS wav FROM n"""


@query("snk_wav", WAV)
def snk_wav(spark, sf_dir):
    """Samples with a head of 44 bytes (SNK12)."""
    return M.table(spark, sf_dir, "documents").select("doc_id", F.sha2(legacy.wav_file(F.encode("text", "UTF-8")), 256).alias("wav"))


OCR = """SELECT id - id % 5 AS moment_id, id % 5 AS line, p.episode_id, p.timestamp_ms, p.timestamp_ms AS t_end_ms, 'ocr' AS type, '' AS thumb_path,
printf('%.3f,%.3f,%.3f,%.3f', (id % 100) / 1000.0, (id % 90) / 500.0, (id % 100 + 64) / 1000.0, (id % 90 + 48) / 500.0) AS bbox, '' AS label, 'line ' || id AS text
FROM points p WHERE id % 5 IN (1, 2) AND id % 7 <> 0"""


@query("str_ocr_branch", with_points(OCR))
def str_ocr_branch(spark, sf_dir):
    """Lines of text read from stored frames, as points of their moments (STR7)."""
    p = points(spark, sf_dir)
    frames = p.filter("type = 'frame'").select("moment_id", "episode_id", "timestamp_ms", F.lit(1000.0).alias("width"), F.lit(500.0).alias("height"))
    x, y = F.col("id") % 100, F.col("id") % 90
    said = F.when(F.col("id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("line "), "id"))
    lines = p.filter("id % 5 IN (1, 2)").select("moment_id", (F.col("id") % 5).alias("line"), said.alias("text"), G.box(x, y, x + 64, y + 48).alias("box"))
    return legacy.ocr_points(frames, lines)


BRANCH = """SELECT 'frame' AS kind, id AS moment_id, NULL AS line, NULL AS text FROM points WHERE type = 'frame'
UNION ALL SELECT 'line', f.id, l.k, 'line ' || (f.id + l.k) FROM points f, (SELECT unnest([1, 2])::INT AS k) l WHERE f.type = 'frame' AND f.id % 35 <> 0 AND (f.id + l.k) % 7 <> 0
UNION ALL SELECT 'failed', id, NULL, 'ValueError: no picture' FROM points WHERE type = 'frame' AND id % 35 = 0"""


@query("stream_ocr_branch", with_points(BRANCH))
def stream_ocr_branch(spark, sf_dir):
    """Frames of a stream are stored, and lines read from them beside it; a frame that can't be read is stored all the same (STR7)."""

    def recognise(frame):
        one = int(frame["moment_id"])
        if one % 35 == 0:
            raise ValueError("no picture")
        return [(k, f"line {one + k}", 0.0, 0.0, 64.0, 48.0) for k in (1, 2) if (one + k) % 7]

    frames = stream(spark, sf_dir, "embeddings").filter("vec_id % 5 = 0").select(F.col("vec_id").alias("moment_id"))
    stored, lines, failed = branch.with_lines(frames, recognise)
    none = lambda kind: F.lit(None).cast(kind)
    out = stored.select(F.lit("frame").alias("kind"), "moment_id", none("int").alias("line"), none("string").alias("text"))
    out = out.unionByName(lines.select(F.lit("line").alias("kind"), "moment_id", "line", "text"))
    return out.unionByName(failed.select(F.lit("failed").alias("kind"), "moment_id", none("int").alias("line"), F.col("error").alias("text")))


@query("geo_between", "SELECT vec_id, round(l + ((vec_id % 7) / 14.0 - l) * 0.3, 6) AS l, round(r + (0.9 - r) * 0.3, 6) AS r FROM (SELECT vec_id, (vec_id % 10) / 20.0 AS l, (vec_id % 10) / 20.0 + 0.3 AS r FROM embeddings)")
def geo_between(spark, sf_dir):
    """Boxes three tenths of the way to the next (GEO6)."""
    e, left = M.table(spark, sf_dir, "embeddings"), (F.col("vec_id") % 10) / 20.0
    zero = F.lit(0.0)
    at = e.select("vec_id", G.between(G.box(left, zero, left + 0.3, zero), G.box((F.col("vec_id") % 7) / 14.0, zero, F.lit(0.9), zero)).alias("b"))
    return at.select("vec_id", F.round("b.l", 6).alias("l"), F.round("b.r", 6).alias("r"))


def paced_sql(hold: str) -> str:
    return f"""WITH RECURSIVE f AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS ts, {hold} AS hold, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
    kept AS (SELECT key, id, ts, ts + hold AS free_at, k FROM f WHERE k = 1
      UNION ALL SELECT f.key, f.id, f.ts, f.ts + f.hold, f.k FROM kept JOIN f ON f.key = kept.key AND f.k = (SELECT min(g.k) FROM f g WHERE g.key = kept.key AND g.k > kept.k AND g.ts >= kept.free_at))
    SELECT key, id, ts FROM kept"""


def lane(spark: SparkSession, sf_dir: str, hold) -> DataFrame:
    e = stream(spark, sf_dir, "events")
    return run.available_now(push.paced(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), M.epoch_ms(F.col("ts")).alias("ts"), hold.cast("long").alias("hold"))))


@query("str_rate_cap", paced_sql("21600000"))
def str_rate_cap(spark, sf_dir):
    """Frames at least so long after the last one taken, on a stream (STR4)."""
    return lane(spark, sf_dir, F.lit(21_600_000))


@query("str_drop_latest", paced_sql("(event_id % 5) * 7200000"))
def str_drop_latest(spark, sf_dir):
    """Frames that find the lane free; each holds it as long as its work takes (STR10)."""
    return lane(spark, sf_dir, (F.col("event_id") % 5) * 7_200_000)


@query("str_generation", "SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS ts FROM (SELECT *, event_id // 1000 AS gen, max(event_id // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS now FROM events) WHERE gen = now")
def str_generation(spark, sf_dir):
    """Frames of an older session than the newest seen are dropped from a stream (STR3)."""
    e = stream(spark, sf_dir, "events")
    frames = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), M.epoch_ms(F.col("ts")).alias("ts"), F.expr("event_id div 1000").alias("generation"))
    return run.available_now(push.newest_generation(frames))


@query("hud_push", """SELECT '{"t":"mark","id":' || event_id || ',"user":' || user_id || '}' AS event FROM events WHERE event_id % 10 = 0""")
def hud_push(spark, sf_dir):
    """Events of a stream sent to a viewer, here one that keeps each message as a file of the shared folder (SNK8, SNK9)."""
    e = stream(spark, sf_dir, "events").filter("event_id % 10 = 0")
    event = F.to_json(F.struct(F.lit("mark").alias("t"), F.col("event_id").alias("id"), F.col("user_id").alias("user")))
    inbox = run.shared_folder(spark)
    push.push(e.select(event.alias("event")), run.shared_folder(spark), push.file_viewer(inbox))
    # a viewer that keeps each message once, however often it was sent
    shown = spark.read.schema("message string, part int, event string").json(inbox).dropDuplicates(["message", "part"])
    return shown.select("event")


@query("hud_replay", with_points("SELECT CAST(moment_id AS VARCHAR) AS id, timestamp_ms AS ts, row_number() OVER (ORDER BY timestamp_ms, id) AS count FROM (SELECT id, moment_id, timestamp_ms FROM points WHERE type = 'frame' ORDER BY timestamp_ms DESC, id DESC LIMIT 60)"))
def hud_replay(spark, sf_dir):
    """What a viewer that connects is shown: the newest sixty moments, oldest first (SNK9, REL18)."""
    newest = scan.newest(points(spark, sf_dir).filter("type = 'frame'").withColumn("id", -F.col("id")), 60)
    rows = newest.select(F.col("moment_id").cast("string").alias("id"), F.col("timestamp_ms").alias("ts"), (-F.col("id")).alias("own"))
    from pyspark.sql import Window

    return rows.select("id", "ts", F.row_number().over(Window.orderBy("ts", "own")).cast("long").alias("count"))  # sixty rows
