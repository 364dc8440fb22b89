"""Queries on pictures, boxes, text lines and sound (IMG, GEO, OCR, SIG, STR1, STR6) and on display events.

Grids are the 64 numbers of a vector as 8 by 8 cells from 0 to 1; detections are lines of orders, an order being a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import scan
from ..sources import moments as M
from .core import query, with_points

GRID = "grids AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: (x + 1.0) / 2) AS g FROM embeddings)"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1.0) / 2).alias("g"))


@query("img_luma", "SELECT o_orderkey, trunc((c >> 16 & 255) * 0.299::DOUBLE + (c >> 8 & 255) * 0.587::DOUBLE + (c & 255) * 0.114::DOUBLE)::INTEGER AS luma FROM (SELECT o_orderkey, o_orderkey * 7919 % 16777216 AS c FROM orders)")
def img_luma(spark, sf_dir):
    return M.table(spark, sf_dir, "orders").select("o_orderkey", G.luminance(F.col("o_orderkey") * 7919 % 16777216).alias("luma"))


@query(
    "img_downscale",
    """SELECT vec_id, round(list_sum(list_transform(m, lambda x, i: x * i)), 6) AS weighted, round(m[1], 6) AS first FROM (
    SELECT vec_id, list_transform(range(0, 16), lambda k: (c[k // 4 * 16 + k % 4 * 2 + 1] + c[k // 4 * 16 + k % 4 * 2 + 2] + c[k // 4 * 16 + k % 4 * 2 + 9] + c[k // 4 * 16 + k % 4 * 2 + 10]) / 4.0 / 255.0) AS m
    FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor((x + 1.0) * 127.5)) AS c FROM embeddings))""",
)
def img_downscale(spark, sf_dir):
    """8 by 8 to 4 by 4 (IMG2)."""
    e = M.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 127.5).cast("double")).alias("c"))
    m = e.select("vec_id", G.downscaled(F.col("c"), 8, 8, 4).alias("m"))
    weighted = F.aggregate(F.transform("m", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return m.select("vec_id", F.round(weighted, 6).alias("weighted"), F.round(F.col("m")[0], 6).alias("first"))


LIKE = "1 - list_sum(list_transform(range(1, 65), lambda i: abs(a.g[i] - b.g[i]))) / 64"


def neighbours(spark, sf_dir) -> DataFrame:
    g = grids(spark, sf_dir)
    return g.join(g.select((F.col("vec_id") + 1).alias("vec_id"), F.col("g").alias("before")), "vec_id").withColumn("s", F.round(G.similarity(F.col("g"), F.col("before")), 6))


@query("img_similarity", f"WITH {GRID} SELECT a.vec_id, round({LIKE}, 6) AS similarity FROM grids a JOIN grids b ON a.vec_id = b.vec_id + 1")
def img_similarity(spark, sf_dir):
    return neighbours(spark, sf_dir).select("vec_id", F.col("s").alias("similarity"))


EDGE = """list_transform(range(0, 64), lambda k: g[greatest(k // 8 - 1, 0) * 8 + k % 8 + 1] + g[least(k // 8 + 1, 7) * 8 + k % 8 + 1] + g[k // 8 * 8 + greatest(k % 8 - 1, 0) + 1] + g[k // 8 * 8 + least(k % 8 + 1, 7) + 1] - 4 * g[k + 1])"""


@query("img_sharpness", f"WITH {GRID} SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)) / 64 - pow(list_sum(e) / 64, 2), 6) AS sharpness FROM (SELECT vec_id, {EDGE} AS e FROM grids)")
def img_sharpness(spark, sf_dir):
    return grids(spark, sf_dir).select("vec_id", F.round(G.sharpness(F.col("g"), 8), 6).alias("sharpness"))


@query("img_channels", "SELECT l_orderkey, l_linenumber, round((l_quantity / 255.0 - 0.48145466) / 0.26862954, 6) AS clip, round((l_quantity / 255.0 - 0.485) / 0.229, 6) AS imagenet, round((l_quantity - 25) * 3.1009655, 4) AS box FROM lineitem")
def img_channels(spark, sf_dir):
    """Channel normalisation and byte codes of boxes (IMG6, IMG7)."""
    q = F.col("l_quantity")
    return M.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(G.channel(q, "clip", 0), 6).alias("clip"), F.round(G.channel(q, "imagenet", 0), 6).alias("imagenet"), F.round(G.dequantised(q, 25, 3.1009655), 4).alias("box")
    )


@query(
    "gate_decide",
    f"""WITH {GRID} SELECT vec_id, CASE WHEN apart < 3000 THEN 'SKIP' WHEN s < 0.94 THEN 'CAPTURE' WHEN apart >= 45000 THEN 'HEARTBEAT' ELSE 'SKIP' END AS decision
    FROM (SELECT a.vec_id, round({LIKE}, 6) AS s, a.vec_id * 7919 % 60000 AS apart FROM grids a JOIN grids b ON a.vec_id = b.vec_id + 1)""",
)
def gate_decide(spark, sf_dir):
    """The capture gate for a given baseline (STR1)."""
    from ..streaming.capture import decision

    n = neighbours(spark, sf_dir)
    return n.select("vec_id", decision(F.col("s"), F.col("vec_id") * 7919 % 60000, 0.94).alias("decision"))


# --- boxes

BOXES = """det AS (SELECT l_orderkey AS frame, l_linenumber AS det, l_returnflag AS label, l_discount + 0.2 AS score,
  (l_partkey % 500)::DOUBLE AS cx, (l_suppkey % 300 + 40)::DOUBLE AS cy, l_quantity * 4 AS w, l_quantity * 3 AS h FROM lineitem),
box AS (SELECT *, least(greatest((cx - w / 2), 0.0), 640.0) AS l, least(greatest((cy - h / 2) * 0.75, 0.0), 480.0) AS t, least(greatest((cx + w / 2), 0.0), 640.0) AS r, least(greatest((cy + h / 2) * 0.75, 0.0), 480.0) AS b FROM det)"""


def detections(spark, sf_dir, lines: DataFrame | None = None) -> DataFrame:
    """Lines of orders as detections; ``lines`` may be the table's stream."""
    li = M.table(spark, sf_dir, "lineitem") if lines is None else lines
    place = G.decoded((F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 300 + 40).cast("double"), F.col("l_quantity") * 4, F.col("l_quantity") * 3, 640.0, 640.0, 480.0)
    return li.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("det"), F.col("l_returnflag").alias("label"), (F.col("l_discount") + 0.2).alias("score"), place.alias("box"), "l_extendedprice"
    ).filter("box IS NOT NULL")


@query("det_decode", f"WITH {BOXES} SELECT frame, det, round(l, 3) AS l, round(t, 3) AS t, round(r, 3) AS r, round(b, 3) AS b FROM box WHERE round(score, 4) >= 0.25 AND r > l AND b > t")
def det_decode(spark, sf_dir):
    d = detections(spark, sf_dir).filter(F.round("score", 4) >= G.SCORE)
    return d.select("frame", "det", *[F.round(F.col(f"box.{c}"), 3).alias(c) for c in "ltrb"])


@query(
    "geo_iou",
    f"""WITH {BOXES}, p AS (SELECT a.frame, a.det AS a, b.det AS b, least(a.r, b.r) - greatest(a.l, b.l) AS w, least(a.b, b.b) - greatest(a.t, b.t) AS h, (a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) AS s
      FROM box a JOIN box b ON a.frame = b.frame AND b.det = a.det + 1 WHERE a.r > a.l AND a.b > a.t AND b.r > b.l AND b.b > b.t)
    SELECT frame, a, b, CASE WHEN w <= 0 OR h <= 0 THEN 0.0 ELSE round(w * h / (s - w * h), 6) END AS iou FROM p""",
)
def geo_iou(spark, sf_dir):
    d = detections(spark, sf_dir).select("frame", "det", "box")
    o = d.select("frame", F.col("det").alias("b"), F.col("box").alias("box2"))
    pairs = d.join(o, "frame").filter("b = det + 1")
    return pairs.select("frame", F.col("det").alias("a"), "b", F.round(G.iou(F.col("box"), F.col("box2")), 6).alias("iou"))


@query(
    "geo_padded_rect",
    f"""WITH {BOXES}, g AS (SELECT frame, det, least(greatest(trunc(l - (r - l) * 0.2::DOUBLE)::INTEGER, 0), 639) AS pl, least(greatest(trunc(t - (b - t) * 0.2::DOUBLE)::INTEGER, 0), 479) AS pt, r + (r - l) * 0.2::DOUBLE AS r2, b + (b - t) * 0.2::DOUBLE AS b2 FROM box WHERE r > l AND b > t)
    SELECT frame, det, pl AS l, pt AS t, least(greatest(trunc(r2)::INTEGER, pl + 1), 640) AS r, least(greatest(trunc(b2)::INTEGER, pt + 1), 480) AS b FROM g""",
)
def geo_padded_rect(spark, sf_dir):
    p = detections(spark, sf_dir).select("frame", "det", G.padded(F.col("box"), 640, 480).alias("p"))
    return p.select("frame", "det", "p.l", "p.t", "p.r", "p.b")


@query("geo_normalised", f"WITH {BOXES} SELECT frame, det, round(l / 640, 8) AS l, round(b / 480, 8) AS b FROM box WHERE r > l AND b > t")
def geo_normalised(spark, sf_dir):
    n = detections(spark, sf_dir).select("frame", "det", G.normalised(F.col("box"), 640.0, 480.0).alias("n"))
    return n.select("frame", "det", F.round("n.l", 8).alias("l"), F.round("n.b", 8).alias("b"))


@query("det_nms")
def det_nms(spark, sf_dir):
    """Suppression is greedy, which SQL doesn't express; tests hold it against a plain loop."""
    return G.suppressed(detections(spark, sf_dir)).select("frame", "label", "det", F.round("score", 6).alias("score"))


@query("trk_topn_regions", "SELECT l_orderkey AS frame, l_linenumber AS det FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 6")
def trk_topn_regions(spark, sf_dir):
    """The six most certain regions of a moment (STR6)."""
    li = M.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("det"), "l_extendedprice")
    w = Window.partitionBy("frame").orderBy(F.desc("l_extendedprice"), "det")
    return li.withColumn("k", F.row_number().over(w)).filter("k <= 6").select("frame", "det")


@query("trk_tracks")
def trk_tracks(spark, sf_dir):
    """Tracks over the detections of a camera, each frame there is being the next tick (STR5, JON9); tests hold it against a plain loop.

    As no frame is missed by number, nothing tells stretches apart, and a camera is followed by one task; ``trk_numbered`` has frame numbers.
    """
    from ..streaming.tracker import tracked

    d = detections(spark, sf_dir).select((F.col("frame") % 97).alias("camera"), F.col("frame").alias("tick"), "det", "label", "score", "box")
    return tracked(d)


# --- text lines


@query(
    "ocr_line_boxes",
    """WITH c AS (SELECT vec_id AS image, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i] AS p FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    m AS (SELECT image, y, min(x) AS x0, max(x) AS x1 FROM c WHERE p > 0.05::FLOAT GROUP BY image, y HAVING count(*) >= 3),
    r AS (SELECT *, y - row_number() OVER (PARTITION BY image ORDER BY y) AS run FROM m)
    SELECT image, greatest(min(x0) - 1, 0) AS l, greatest(min(y) - 1, 0) AS t, least(max(x1) + 1, 8) AS r, least(max(y) + 2, 8) AS b FROM r GROUP BY image, run HAVING max(y) - min(y) + 1 >= 2""",
)
def ocr_line_boxes(spark, sf_dir):
    e = M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "p"))
    cells = e.select("image", F.floor(F.col("i") / 8).cast("long").alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.col("p"))
    return G.line_boxes(cells.withColumn("p", F.when(F.col("p") > F.lit(0.05).cast("float"), 1.0).otherwise(0.0)), 8, 8, 0.5, least_rows=2, pad=1)


STEPS = "st AS (SELECT vec_id AS line, k AS t, embedding[k * 8 + 1:k * 8 + 8]::DOUBLE[] AS s FROM embeddings, (SELECT unnest(range(0, 8)) AS k)), w AS (SELECT line, t, list_max(s) AS best, list_position(s, list_max(s)) - 1 AS k FROM st)"


def steps(spark, sf_dir) -> DataFrame:
    e = M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), F.col("embedding"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    return e.select("line", "t", F.transform(F.slice("embedding", F.col("t") * 8 + 1, F.lit(8)), lambda x: x.cast("double")).alias("scores"))


@query(
    "ocr_ctc",
    f"""WITH {STEPS}, n AS (SELECT * FROM (SELECT *, lag(k) OVER (PARTITION BY line ORDER BY t) AS was FROM w) WHERE k > 0 AND (was IS NULL OR was <> k))
    SELECT vec_id AS line, coalesce(text, '') AS text, coalesce(conf, 0.0) AS conf FROM embeddings LEFT JOIN (SELECT line, string_agg(['a', 'b', 'c', 'd', 'e', 'f', 'g'][k], '' ORDER BY t) AS text, round(avg(best), 6) AS conf FROM n GROUP BY line) ON line = vec_id""",
)
def ocr_ctc(spark, sf_dir):
    return G.ctc(steps(spark, sf_dir), list("abcdefg"))


@query(
    "ocr_until_stop",
    f"""WITH {STEPS}, z AS (SELECT line, min(t) AS stop FROM w WHERE t > 0 AND k = 1 GROUP BY line)
    SELECT line, string_agg(['a', 'b', 'c', 'd', 'e', 'f'][k - 1], '' ORDER BY t) AS text, round(avg(best), 6) AS conf FROM w LEFT JOIN z USING (line) WHERE t > 0 AND k >= 2 AND (stop IS NULL OR t < stop) GROUP BY line""",
)
def ocr_until_stop(spark, sf_dir):
    return G.until_stop(steps(spark, sf_dir), list("abcdef"))


# --- sound


@query("sig_rms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x * 1000000)) / 64), 4) AS rms FROM embeddings")
def sig_rms(spark, sf_dir):
    loud = F.transform("embedding", lambda x: x.cast("double") * 1000)
    return M.table(spark, sf_dir, "embeddings").select("vec_id", F.round(G.rms(loud), 4).alias("rms"))


@query(
    "sig_endpoint",
    """WITH c AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ts FROM events WHERE value > 50), n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) <= 3600000 THEN 0 ELSE 1 END AS new FROM c),
    r AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts) AS run FROM n) SELECT key, min(ts) AS start_ms, max(ts) AS end_ms, count(*) AS chunks FROM r GROUP BY key, run""",
)
def sig_endpoint(spark, sf_dir):
    e = M.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), M.epoch_ms(F.col("ts")).alias("ts"), F.col("value").alias("rms"))
    return G.speech_runs(e, 50.0, 3_600_000).select("key", "start_ms", "end_ms", "chunks")


@query(
    "sig_trim",
    "SELECT l_orderkey, l_linenumber, CASE WHEN e - s >= 8000 THEN s END AS first, CASE WHEN e - s >= 8000 THEN e END AS last FROM (SELECT l_orderkey, l_linenumber, s - s % 2 AS s, e - e % 2 AS e FROM (SELECT l_orderkey, l_linenumber, greatest(l_partkey - 9600, 0) AS s, least(l_partkey + l_suppkey * 11 + 9600, 50001) AS e FROM lineitem))",
)
def sig_trim(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    t = M.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.trimmed(p, p + s * 11, F.lit(50001)).alias("t"))
    return t.select("l_orderkey", "l_linenumber", "t.first", "t.last")


# --- what the display is sent


@query(
    "hud_results_event",
    with_points(
        """SELECT moment_id, '{"t":"results","items":[' || string_agg('{"id":"moment_' || moment_id || '","label":"' || label || '","score":' || floor(yolo_conf * 100) / 100 || CASE WHEN label <> '' THEN ',"tags":["' || label || '"]' ELSE '' END || '}', ',' ORDER BY id) || ']}' AS event
        FROM points WHERE type = 'region' GROUP BY moment_id"""
    ),
)
def hud_results_event(spark, sf_dir):
    """A moment's regions as one event; tags are left out where there are none (HUD events)."""
    p = M.points(spark, sf_dir).filter("type = 'region'")
    key = F.regexp_extract("thumb_path", r"([^/]*)\.[^./]*$", 1)
    item = F.struct(key.alias("id"), F.col("label"), (F.floor(F.col("yolo_conf") * 100) / 100).alias("score"), F.when(F.col("label") != "", F.array("label")).alias("tags"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))), lambda s: s["x"])
    g = p.groupBy("moment_id").agg(items.alias("items"))
    return g.select("moment_id", F.to_json(F.struct(F.lit("results").alias("t"), "items")).alias("event"))


@query(
    "hud_boxes_event",
    f"""WITH {BOXES} SELECT frame, '{{"t":"boxes","frame":[640,480],"items":[' || string_agg('{{"id":' || det || ',"label":"' || label || '","x":' || trunc(l)::INTEGER || ',"y":' || trunc(t)::INTEGER || ',"w":' || trunc(r - l)::INTEGER || ',"h":' || trunc(b - t)::INTEGER || '}}', ',' ORDER BY det, label, trunc(l), trunc(t), trunc(r - l), trunc(b - t)) || ']}}' AS event
    FROM box WHERE r > l AND b > t GROUP BY frame""",
)
def hud_boxes_event(spark, sf_dir):
    b = lambda x: F.col(f"box.{x}")
    item = F.struct(
        F.col("det").alias("id"), "label", b("l").cast("int").alias("x"), b("t").cast("int").alias("y"), (b("r") - b("l")).cast("int").alias("w"), (b("b") - b("t")).cast("int").alias("h")
    )
    g = detections(spark, sf_dir).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("det", item.alias("x")))), lambda s: s["x"]).alias("items"))
    return g.select("frame", F.to_json(F.struct(F.lit("boxes").alias("t"), F.array(F.lit(640), F.lit(480)).alias("frame"), "items")).alias("event"))


@query("hud_mode_event", """SELECT o_orderkey, '{"t":"mode","value":"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"query":"' || o_orderpriority || '"' ELSE '' END || '}' AS event FROM orders""")
def hud_mode_event(spark, sf_dir):
    """An absent query is left out."""
    ask = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    return M.table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.lit("mode").alias("t"), F.col("o_orderstatus").alias("value"), ask.alias("query"))).alias("event"))


@query("hud_queue", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 64")
def hud_queue(spark, sf_dir):
    """The last 64 of each client: a queue that drops its oldest (SNK10), and the ring of recent frames (STR9)."""
    e = M.table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return scan.last_of_each(e, "user_id", "ts", 64).select(F.col("id").alias("event_id"), "user_id")


def grid_column(name: str = "embedding") -> Column:
    return F.transform(name, lambda x: (x.cast("double") + 1.0) / 2)
