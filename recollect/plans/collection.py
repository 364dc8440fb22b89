"""Queries on the collection: scans, filters, payloads, paging and synchronisation (FLT, PRJ, REL, SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scan, sync
from ..sources import moments as M
from ..sources import ranges
from ..streaming import run
from .core import query, with_points

#: A window within the first day of the events.
SINCE, UNTIL = 1704078000000, 1704099599999

ROW = ["id", "moment_id", "type", "timestamp_ms", "label", "thumb_path"]
COLS = ", ".join(ROW)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.points(spark, sf_dir)


@query("rel_count", "SELECT count(*) AS n FROM embeddings JOIN events ON event_id = vec_id")
def rel_count(spark, sf_dir):
    vectors, events = M.table(spark, sf_dir, "embeddings"), M.table(spark, sf_dir, "events")
    return vectors.join(events, F.col("vec_id") == F.col("event_id")).agg(F.count("*").alias("n"))


@query("rel_frame_count", with_points("SELECT count(*) FILTER (type = 'frame') AS frames, count(*) AS n FROM points"))
def rel_frame_count(spark, sf_dir):
    return points(spark, sf_dir).agg(F.count_if(F.col("type") == "frame").alias("frames"), F.count("*").alias("n"))


@query("rel_timeline", with_points(f"SELECT {COLS} FROM (SELECT * FROM points WHERE type = 'frame' ORDER BY timestamp_ms DESC, id LIMIT 500)"))
def rel_timeline(spark, sf_dir):
    return scan.timeline(points(spark, sf_dir)).select(*ROW)


def window_sql(condition: str, limit: int = 100) -> str:
    return with_points(f"SELECT {COLS} FROM points WHERE type = 'frame' AND {condition} ORDER BY timestamp_ms DESC, id LIMIT {limit}")


@query("rel_frames_in_window", window_sql(f"timestamp_ms >= {SINCE} AND timestamp_ms <= {UNTIL}"))
def rel_frames_in_window(spark, sf_dir):
    return scan.newest(scan.of_type(points(spark, sf_dir), "frame", SINCE, UNTIL), 100).select(*ROW)


@query("rel_window_since_only", window_sql(f"timestamp_ms >= {SINCE}"))
def rel_window_since_only(spark, sf_dir):
    return scan.newest(scan.of_type(points(spark, sf_dir), "frame", SINCE), 100).select(*ROW)


@query("rel_window_until_only", window_sql(f"timestamp_ms <= {UNTIL}"))
def rel_window_until_only(spark, sf_dir):
    return scan.newest(scan.of_type(points(spark, sf_dir), "frame", None, UNTIL), 100).select(*ROW)


@query("rel_timeline_label", with_points(f"SELECT {COLS} FROM points WHERE type = 'region' AND label = 'car' ORDER BY timestamp_ms DESC, id LIMIT 50"))
def rel_timeline_label(spark, sf_dir):
    return scan.newest(scan.of_type(points(spark, sf_dir), "region", label="car"), 50).select(*ROW)


@query("flt_window_all_types", with_points(f"SELECT {COLS} FROM points WHERE timestamp_ms BETWEEN {SINCE} AND {UNTIL}"))
def flt_window_all_types(spark, sf_dir):
    """The shared corpus is filtered by time alone (FLT2, FLT8)."""
    return scan.of_type(points(spark, sf_dir), None, SINCE, UNTIL).select(*ROW)


#: Slots of the indexes at least, so that small tables have several too; their number doesn't grow with the rows until a slot is full.
SLOTS = 20


def indexed(spark: SparkSession, sf_dir: str) -> ranges.RangeIndex:
    """A new index of the collection by time, about twenty slots or more; the collection is derived once for its several readings."""
    place = run.shared_folder(spark)
    points(spark, sf_dir).select(*ROW).write.parquet(place)
    return ranges.RangeIndex.build(spark.read.parquet(place), run.shared_folder(spark), slots=SLOTS)


@query("rel_timeline_indexed", with_points(f"SELECT {COLS} FROM points WHERE type = 'frame' ORDER BY timestamp_ms DESC, id LIMIT 50"))
def rel_timeline_indexed(spark, sf_dir):
    """The newest frames from the newest slots of an index by time (REL4)."""
    return indexed(spark, sf_dir).first(50, "frame").select(*ROW)


@query("rel_window_indexed", window_sql(f"timestamp_ms >= {SINCE} AND timestamp_ms <= {UNTIL}"))
def rel_window_indexed(spark, sf_dir):
    """The newest frames of a window, by the slots that it touches (REL5)."""
    return indexed(spark, sf_dir).first(100, "frame", SINCE, UNTIL).select(*ROW)


@query("rel_label_indexed", with_points(f"SELECT {COLS} FROM points WHERE type = 'region' AND label = 'car' ORDER BY timestamp_ms DESC, id LIMIT 3"))
def rel_label_indexed(spark, sf_dir):
    """The newest regions with a label: more slots are looked at until there are enough (REL6)."""
    return indexed(spark, sf_dir).first(3, "region", where=F.col("label") == "car").select(*ROW)


@query("rel_page_indexed", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 500")
def rel_page_indexed(spark, sf_dir):
    """A page in key order from the slots after its cursor (REL7)."""
    o = M.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranges.RangeIndex.build(o, run.shared_folder(spark), "o_orderkey", None, "o_custkey", slots=SLOTS).page(500, 5000)


@query("rel_keyset_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 500")
def rel_keyset_page(spark, sf_dir):
    return scan.page_after(M.table(spark, sf_dir, "orders"), "o_orderkey", 5000, 500).select("o_orderkey", "o_custkey", "o_totalprice")


@query("rel_all_oldest", with_points(f"SELECT {COLS} FROM points WHERE type = 'region' ORDER BY timestamp_ms, id LIMIT 500"))
def rel_all_oldest(spark, sf_dir):
    return points(spark, sf_dir).filter("type = 'region'").orderBy("timestamp_ms", "id").limit(500).select(*ROW)


@query(
    "rel_rail_snapshot",
    with_points(
        """SELECT '{"t":"moment","id":"moment_' || moment_id || '","ts":' || timestamp_ms || ',"count":' || row_number() OVER (ORDER BY timestamp_ms, id) || '}' AS event FROM points WHERE type = 'frame'"""
    ),
)
def rel_rail_snapshot(spark, sf_dir):
    """What a new viewer is sent: all frames, oldest first, each with the count so far (REL9)."""
    frames = points(spark, sf_dir).filter("type = 'frame'").select("id", "timestamp_ms", "thumb_path")
    # a running count over everything: counted by day first, so a day's frames are numbered alone
    day = F.floor(F.col("timestamp_ms") / 86_400_000)
    frames = frames.withColumn("day", day)
    before = frames.groupBy("day").agg(F.count("*").alias("n")).select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("day").orderBy("timestamp_ms", "id"))
    counted = frames.withColumn("k", own).join(before, "day")
    key = F.regexp_extract("thumb_path", r"([^/]*)\.[^./]*$", 1)
    event = F.struct(F.lit("moment").alias("t"), key.alias("id"), F.col("timestamp_ms").alias("ts"), (F.col("before") + F.col("k")).alias("count"))
    return counted.select(F.to_json(event).alias("event"))


@query(
    "rel_unsynced",
    with_points("SELECT id, timestamp_ms FROM (SELECT * FROM points WHERE type = 'frame' AND NOT coalesce(synced, false) ORDER BY id LIMIT 1000) WHERE thumb_path <> '' ORDER BY id LIMIT 100"),
)
def rel_unsynced(spark, sf_dir):
    return sync.backlog(points(spark, sf_dir), F.col("thumb_path") != "").select("id", "timestamp_ms")


@query(
    "rel_fleet_point",
    with_points(
        """SELECT id::VARCHAR AS id, len(clip)::INTEGER AS dims, timestamp_ms, label, NULL::VARCHAR AS synced FROM points WHERE id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 """
    ).replace("id::VARCHAR AS id", "'00000000-0000-0000-0000-' || lpad(id::VARCHAR, 12, '0') AS id"),
)
def rel_fleet_point(spark, sf_dir):
    """Records of several shapes (plain, tagged and missing vectors, broken payloads, other ids) mapped for the shared corpus (REL11)."""
    p = points(spark, sf_dir)
    clip = F.to_json("clip")
    tagged = F.concat(F.lit('{"clip":{"dense":'), clip, F.lit("}}"))
    vector = F.when(F.pmod("id", F.lit(11)) == 0, F.lit("{}")).when(F.pmod("id", F.lit(2)) == 0, tagged).otherwise(clip)
    payload = F.when(F.pmod("id", F.lit(13)) == 0, F.lit('{"type":"fra')).otherwise(M.payload_json(p))
    name = F.concat(F.when(F.pmod("id", F.lit(17)) == 0, F.lit("n-")).otherwise(F.lit("00000000-0000-0000-0000-")), F.lpad(F.col("id").cast("string"), 12, "0"))
    out = sync.to_fleet(p.select(name.alias("id"), vector.alias("vector"), payload.alias("payload")))
    field = lambda k: F.try_element_at("payload", F.lit(k))
    return out.select("id", F.size("vector").alias("dims"), field("timestamp_ms").cast("long").alias("timestamp_ms"), field("label").alias("label"), field("synced").alias("synced"))


@query("rel_mark_synced", with_points("SELECT id, CASE WHEN type = 'frame' AND NOT coalesce(synced, false) THEN true ELSE synced END AS synced, label FROM points"))
def rel_mark_synced(spark, sf_dir):
    p = points(spark, sf_dir)
    return sync.mark_synced(p, scan.unsynced(p).select("id")).select("id", "synced", "label")


@query(
    "rel_upsert_idempotent",
    with_points("SELECT id, label, timestamp_ms FROM points WHERE type <> 'region' UNION ALL SELECT id, 'new', timestamp_ms FROM points WHERE type = 'region'"),
)
def rel_upsert_idempotent(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "label", "timestamp_ms", "type")
    rows = p.filter("type = 'region'").withColumn("label", F.lit("new"))
    return sync.upsert(sync.upsert(p, rows), rows).select("id", "label", "timestamp_ms")


@query("rel_approve", with_points("SELECT id, curated OR type = 'ocr' AS curated FROM points"))
def rel_approve(spark, sf_dir):
    p = points(spark, sf_dir)
    return sync.approve(p, p.filter("type = 'ocr'").select("id")).select("id", "curated")


@query("flt_curated", with_points("SELECT id, label FROM points WHERE curated"))
def flt_curated(spark, sf_dir):
    return points(spark, sf_dir).filter("curated").select("id", "label")


@query(
    "rel_curate",
    with_points("SELECT id, CASE WHEN curated THEN 'inbox' ELSE 'shelf' END AS origin FROM points WHERE curated OR type = 'frame'"),
)
def rel_curate(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "type", "clip", "curated")
    shelf = p.filter("type = 'frame'").withColumn("origin", F.lit("shelf"))
    return sync.curate(p.withColumn("origin", F.lit("inbox")), shelf).select("id", "origin")


@query("rel_seed_shard", with_points("SELECT row_number() OVER (ORDER BY id) AS seq, id, 'FLEET: ' || coalesce(nullif(label, ''), moment_id::VARCHAR) AS label FROM points WHERE type = 'frame'"))
def rel_seed_shard(spark, sf_dir):
    return sync.seed(points(spark, sf_dir))


@query(
    "rel_collection_counts",
    with_points("SELECT 'inbox' AS name, count(*) AS n FROM points UNION ALL SELECT 'curated', count(*) FROM points WHERE curated UNION ALL SELECT 'frames', count(*) FROM points WHERE type = 'frame'"),
)
def rel_collection_counts(spark, sf_dir):
    p = points(spark, sf_dir)
    one = p.agg(F.count("*").alias("inbox"), F.count_if("curated").alias("curated"), F.count_if(F.col("type") == "frame").alias("frames"))
    return one.select(F.explode(F.create_map(*[x for c in ("inbox", "curated", "frames") for x in (F.lit(c), F.col(c))])).alias("name", "n"))


@query(
    "rel_rail_top40",
    with_points("SELECT id, episode_id, timestamp_ms FROM points WHERE type = 'frame' QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY timestamp_ms DESC, id DESC) <= 40"),
)
def rel_rail_top40(spark, sf_dir):
    return scan.last_of_each(points(spark, sf_dir).filter("type = 'frame'"), "episode_id", "timestamp_ms", 40).select("id", "episode_id", "timestamp_ms")


@query("rel_event_cursor", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 400")
def rel_event_cursor(spark, sf_dir):
    return M.table(spark, sf_dir, "events").filter("event_id > 400").select("event_id", "user_id", "event_type")


@query("rel_pager", with_points("SELECT id, episode_id FROM points QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY timestamp_ms, id) = 2"))
def rel_pager(spark, sf_dir):
    """The second card of each episode (REL20)."""
    w = Window.partitionBy("episode_id").orderBy("timestamp_ms", "id")
    return points(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k = 2").select("id", "episode_id")


@query(
    "rel_dump_all",
    with_points("SELECT id, coalesce(type, '?') AS type, regexp_extract(thumb_path, '[^/]*$') AS file, timestamp_ms, coalesce(d.text, '') AS transcript FROM points LEFT JOIN documents d ON d.doc_id = id AND type = 'ocr' ORDER BY id LIMIT 1000"),
)
def rel_dump_all(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    p = points(spark, sf_dir).join(docs, "id", "left")
    said = F.when(F.col("type") == "ocr", F.coalesce("text", F.lit(""))).otherwise("")
    return p.select("id", F.coalesce("type", F.lit("?")).alias("type"), F.regexp_extract("thumb_path", "[^/]*$", 0).alias("file"), "timestamp_ms", said.alias("transcript")).orderBy("id").limit(1000)


@query("rel_track_bookkeeping", "SELECT l_orderkey AS track, count(*) AS sightings, count(*) >= 3 AND min(l_linenumber) = 1 AND NOT bool_or(l_returnflag = 'R') AS waiting FROM lineitem GROUP BY l_orderkey")
def rel_track_bookkeeping(spark, sf_dir):
    """Tracks seen three times and not embedded yet (FLT13, REL22)."""
    g = M.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"))
    g = g.agg(F.count("*").alias("sightings"), F.bool_or(F.col("l_returnflag") == "R").alias("embedded"), F.min("l_linenumber").alias("first"))
    return g.select("track", "sightings", ((F.col("sightings") >= 3) & (F.col("first") == 1) & ~F.col("embedded")).alias("waiting"))


@query("flt_keyword", "SELECT doc_id AS id, length(text) AS chars FROM documents WHERE contains(text, 'Licensed') ORDER BY doc_id LIMIT 5")
def flt_keyword(spark, sf_dir):
    docs = M.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return scan.keyword_hits(docs, "text", "Licensed").select("id", F.length("text").cast("long").alias("chars"))


@query("flt_label_gate", with_points("SELECT id, CASE WHEN verify_cos >= 0.06 THEN class_name ELSE '' END AS label FROM points WHERE type = 'region'"))
def flt_label_gate(spark, sf_dir):
    p = points(spark, sf_dir).filter("type = 'region'")
    return p.select("id", scan.verified_label(F.col("class_name"), F.col("verify_cos"), M.VERIFY_GATE).alias("label"))


@query("flt_post_label", with_points("SELECT id, label FROM points WHERE lower(label) = lower('TRAIN')"))
def flt_post_label(spark, sf_dir):
    return points(spark, sf_dir).filter(F.lower("label") == F.lower(F.lit("TRAIN"))).select("id", "label")


@query("flt_min_text", "SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 2")
def flt_min_text(spark, sf_dir):
    return M.table(spark, sf_dir, "conversations").filter(F.length(F.trim("text")) >= 2).select("conv_id", "turn")


def broken(p: DataFrame) -> DataFrame:
    """Payloads of which some are broken, some not an object, and some lack fields."""
    kind = F.pmod("id", F.lit(6))
    text = M.payload_json(p)
    short = F.to_json(F.struct(F.col("type"), F.col("timestamp_ms")))
    return p.select("id", F.when(kind == 0, "{broken").when(kind == 1, "7").when(kind == 2, short).otherwise(text).alias("payload"))


@query(
    "prj_payload_tolerant",
    with_points(
        """SELECT id, CASE WHEN id % 6 < 2 THEN '' ELSE type END AS type, CASE WHEN id % 6 < 2 THEN 0 ELSE timestamp_ms END AS timestamp_ms,
        CASE WHEN id % 6 < 3 THEN '' ELSE label END AS label, CASE WHEN id % 6 < 3 THEN 0.0 ELSE verify_cos END AS verify_cos FROM points"""
    ),
)
def prj_payload_tolerant(spark, sf_dir):
    hit = broken(points(spark, sf_dir)).withColumn("hit", M.payload_tolerant(F.col("payload")))
    return hit.select("id", "hit.type", "hit.timestamp_ms", "hit.label", "hit.verify_cos")


@query("prj_payload_strict", with_points("SELECT id, type, timestamp_ms, CASE WHEN id % 6 = 2 THEN '' ELSE label END AS label FROM points WHERE id % 6 >= 2"))
def prj_payload_strict(spark, sf_dir):
    return M.payload_strict(broken(points(spark, sf_dir)), "payload").select("id", "hit.type", "hit.timestamp_ms", "hit.label")


@query("prj_cards", with_points("SELECT id::VARCHAR AS id, regexp_extract(thumb_path, '([^/]*)\\.[^./]*$', 1) AS thumb_key, [timestamp_ms, timestamp_ms] AS span, 'moment' AS type, verify_cos AS strength FROM points"))
def prj_cards(spark, sf_dir):
    """Ids as text, file names without ending, hits as cards (PRJ3-PRJ5)."""
    key = F.regexp_extract("thumb_path", r"([^/]*)\.[^./]*$", 1)
    span = F.array("timestamp_ms", "timestamp_ms")
    return points(spark, sf_dir).select(F.col("id").cast("string").alias("id"), key.alias("thumb_key"), span.alias("span"), F.lit("moment").alias("type"), F.col("verify_cos").alias("strength"))


@query("prj_regex_fields", with_points("SELECT id, type, label, timestamp_ms, 0::BIGINT AS missing FROM points"))
def prj_regex_fields(spark, sf_dir):
    p = points(spark, sf_dir)
    raw = p.select("id", M.payload_json(p).alias("j"))
    j = F.col("j")
    return raw.select("id", M.regex_string(j, "type").alias("type"), M.regex_string(j, "label").alias("label"), M.regex_long(j, "timestamp_ms").alias("timestamp_ms"), M.regex_long(j, "nothing").alias("missing"))


@query("prj_t_end", "SELECT event_id, CASE WHEN value > 100 THEN epoch_us(ts) // 1000 + floor(value)::BIGINT ELSE epoch_us(ts) // 1000 END AS t_end_ms FROM events")
def prj_t_end(spark, sf_dir):
    """An end of 0 means the start (PRJ7)."""
    e = M.table(spark, sf_dir, "events").withColumn("s", M.epoch_ms(F.col("ts")))
    end = F.when(F.col("value") > 100, F.col("s") + F.floor("value")).otherwise(0)
    return e.select("event_id", F.when(end > 0, end).otherwise(F.col("s")).alias("t_end_ms"))


@query("src_class_names", "SELECT p_partkey, coalesce(" + "{names}" + "[p_size + 30], 'unknown') AS name FROM part")
def src_class_names(spark, sf_dir):
    return M.table(spark, sf_dir, "part").select("p_partkey", M.class_name(F.col("p_size") + 29).alias("name"))


@query("snk_stamped", with_points("SELECT id, 'frame' AS type, id AS moment_id, timestamp_ms FROM points WHERE type = 'frame' UNION ALL SELECT id, 'region', moment_id, timestamp_ms FROM points WHERE type = 'region' UNION ALL SELECT id, 'ocr', moment_id, timestamp_ms FROM points WHERE type = 'ocr'"))
def snk_stamped(spark, sf_dir):
    """What the store stamps on rows that it is given: a frame's own id as its moment's, and the type of each channel (SNK1-SNK3)."""
    p = points(spark, sf_dir).select("id", "moment_id", "timestamp_ms", F.col("type").alias("kind"))
    stamp = lambda kind, moment: p.filter(F.col("kind") == kind).select("id", F.lit(kind).alias("type"), moment.alias("moment_id"), "timestamp_ms")
    return stamp("frame", F.col("id")).unionByName(stamp("region", F.col("moment_id"))).unionByName(stamp("ocr", F.col("moment_id")))
