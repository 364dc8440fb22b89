"""Queries that search: vectors, fusion, interval joins, evaluation (VEC, FUS, JON, EVL, AGG, WIN, SRT, SET)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import querytext as T
from ..functions import vectors as V
from ..operators import ann, fusion, intervals, pairs, scan, search
from ..operators.ranking import numbered
from ..sources import encoders
from ..sources import moments as M
from ..streaming import run
from .collection import SINCE, UNTIL, points
from .core import query, with_points

NOW = 1706745600000  # after the last event


def one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return M.table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


ONE = "queries AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
MANY = "queries AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)"
SCORED = "scored AS (SELECT p.*, qid, round(list_cosine_similarity(p.clip, q), 6) AS score FROM points p, queries)"


def knn_sql(condition: str, k: int = 5, queries: str = ONE, columns: str = "qid, id, score, rank") -> str:
    return with_points(
        f", {queries}, {SCORED} SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored WHERE {condition}) WHERE rank <= {k}"
    )


FOUND = ["qid", "id", "score", "rank"]


def places(p: DataFrame) -> DataFrame:
    """What a search needs of points where no more than ids and scores are asked for."""
    return p.select("id", "clip")


def found(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("vec_knn", knn_sql("true"))
def vec_knn(spark, sf_dir):
    return found(search.knn(places(points(spark, sf_dir)), one_query(spark, sf_dir)))


@query("vec_knn_batch", knn_sql("true", 10, MANY))
def vec_knn_batch(spark, sf_dir):
    return found(search.knn(places(points(spark, sf_dir)), query_set(spark, sf_dir), 10))


@query("vec_knn_filtered", knn_sql(f"timestamp_ms BETWEEN {SINCE} AND {UNTIL}", 5, MANY))
def vec_knn_filtered(spark, sf_dir):
    return found(search.knn(places(scan.of_type(points(spark, sf_dir), None, SINCE, UNTIL)), query_set(spark, sf_dir)))


def channel(kind: str):
    def run(spark, sf_dir):
        return found(search.knn(places(scan.of_type(points(spark, sf_dir), kind, SINCE, UNTIL)), query_set(spark, sf_dir)))

    return run


for _name, _kind in (("vec_channel_frames", "frame"), ("vec_channel_regions", "region"), ("vec_channel_ocr", "ocr")):
    query(_name, knn_sql(f"type = '{_kind}' AND timestamp_ms BETWEEN {SINCE} AND {UNTIL}", 5, MANY))(channel(_kind))


@query("vec_mobile_label", knn_sql("type = 'region' AND label = 'bus'", 20, MANY))
def vec_mobile_label(spark, sf_dir):
    return found(search.knn(places(scan.of_type(points(spark, sf_dir), "region", label="bus")), query_set(spark, sf_dir), 20))


@query(
    "vec_overfetch",
    with_points(
        f""", {MANY}, {SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM scored)
        SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM c WHERE r <= 200 AND timestamp_ms BETWEEN {SINCE} AND {UNTIL} QUALIFY rank <= 5"""
    ),
)
def vec_overfetch(spark, sf_dir):
    return found(search.overfetch(points(spark, sf_dir).select("id", "timestamp_ms", "clip"), query_set(spark, sf_dir), scan.in_window(SINCE, UNTIL)))


CODE = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {v}[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END))::HUGEINT"


def binary_sql(condition: str) -> str:
    code = lambda v: CODE.format(v=v)
    return with_points(
        f""", {MANY}, coded AS (SELECT p.id, p.clip, qid, q, bit_count(xor({code('p.clip')}, {code('q')})) AS apart FROM points p, queries WHERE {condition}),
        near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY apart, id) AS r FROM coded)
        SELECT qid, id, round(list_cosine_similarity(clip, q), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(clip, q), 6) DESC, id) AS rank
        FROM near WHERE r <= 160 QUALIFY rank <= 5"""
    )


@query("vec_binary_rescore", binary_sql("true"))
def vec_binary_rescore(spark, sf_dir):
    return found(search.binary(places(points(spark, sf_dir)), query_set(spark, sf_dir)))


@query("vec_binary_filtered", binary_sql(f"timestamp_ms BETWEEN {SINCE} AND {UNTIL}"))
def vec_binary_filtered(spark, sf_dir):
    return found(search.binary(places(scan.of_type(points(spark, sf_dir), None, SINCE, UNTIL)), query_set(spark, sf_dir)))


@query(
    "vec_uint8",
    """SELECT vec_id, list_sum(c)::BIGINT AS code_sum, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(c, lambda x: x / 127.5 - 1.0)), 6) AS fidelity
    FROM (SELECT vec_id, embedding, list_transform(embedding::DOUBLE[], lambda x: least(greatest(floor((x + 1.0) * 127.5), 0), 255)::INTEGER) AS c FROM embeddings)""",
)
def vec_uint8(spark, sf_dir):
    """Vectors as bytes: their codes' sum and how near what they give back is (VEC10)."""
    e = M.table(spark, sf_dir, "embeddings").withColumn("c", V.to_uint8(F.col("embedding")))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x)
    return e.select("vec_id", total.alias("code_sum"), F.round(V.cosine(F.col("embedding"), V.from_uint8(F.col("c"))), 6).alias("fidelity"))


@query(
    "vec_half",
    """SELECT vec_id, round(list_sum(h), 5) AS total, round(list_cosine_similarity(embedding::DOUBLE[], h), 6) AS fidelity FROM (
    SELECT vec_id, embedding, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END) AS h FROM embeddings)""",
)
def vec_half(spark, sf_dir):
    """Vectors as 16-bit floating point keeps them: what they add up to and how near they are (VEC10)."""
    e = M.table(spark, sf_dir, "embeddings").withColumn("h", encoders.half(F.col("embedding")))
    total = F.aggregate("h", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return e.select("vec_id", F.round(total, 5).alias("total"), F.round(V.cosine(F.col("embedding"), F.col("h")), 6).alias("fidelity"))


@query(
    "vec_distance_to_similarity",
    f"""WITH {MANY} SELECT qid, vec_id, round(1.0 - (1.0 - list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS by_cosine,
    round(1.0 - list_sum(list_transform(range(1, 65), lambda i: (embedding::DOUBLE[][i] - q[i]) * (embedding::DOUBLE[][i] - q[i]))) / 2, 5) AS by_l2 FROM embeddings, queries""".replace("embedding::DOUBLE[][i]", "(embedding::DOUBLE[])[i]"),
)
def vec_distance_to_similarity(spark, sf_dir):
    e = M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return pairs.compared(e, query_set(spark, sf_dir), "embedding", similarity=True, name="vec_id")


@query(
    "vec_cosine_guarded",
    f"WITH {MANY} SELECT qid, vec_id, CASE vec_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], q), 6) END AS score FROM embeddings, queries",
)
def vec_cosine_guarded(spark, sf_dir):
    """Vectors of zeros and of another length score 0 (VEC14)."""
    e = M.table(spark, sf_dir, "embeddings")
    kind = F.pmod("vec_id", F.lit(4))
    v = F.when(kind == 0, F.transform("embedding", lambda _: F.lit(0.0).cast("float"))).when(kind == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    found = pairs.compared(e.select(F.col("vec_id").alias("id"), v.alias("v")), query_set(spark, sf_dir), "v")
    return found.select("qid", F.col("id").alias("vec_id"), F.col("by_cosine").alias("score"))


@query(
    "vec_l2_normalize",
    "SELECT vec_id, round(list_sum(list_transform(n, lambda x: x * x)), 6) AS squared, round(n[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS n FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings))",
)
def vec_l2_normalize(spark, sf_dir):
    n = V.normalised(F.transform("embedding", lambda x: x.cast("double") * 3))
    e = M.table(spark, sf_dir, "embeddings").select("vec_id", n.alias("n"))
    return e.select("vec_id", F.round(V.dot(F.col("n"), F.col("n")), 6).alias("squared"), F.round(F.col("n")[0], 6).alias("first"))


@query(
    "vec_label_verify",
    "WITH a AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS anchor FROM embeddings GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], anchor), 6) AS verify FROM embeddings JOIN a USING (label)",
)
def vec_label_verify(spark, sf_dir):
    """One vector for each label, and the cosine of each point to its label's (VEC16, JON10)."""
    e = M.table(spark, sf_dir, "embeddings")
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return e.join(anchors, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("anchor")), 6).alias("verify"))


#: Parts that the pairs of an episode and type are dealt to.
PAIR_PARTS = 8

PAIRS = """SELECT p.type AS type, count(*) AS pairs, round(min(s), 6) AS lowest, round(avg(s), 6) AS mean, round(max(s), 6) AS highest
FROM (SELECT a.type, list_cosine_similarity(a.clip, b.clip) AS s FROM points a JOIN points b ON a.episode_id = b.episode_id AND a.type = b.type AND a.id < b.id) p GROUP BY p.type"""


@query("vec_pairwise", with_points(PAIRS))
def vec_pairwise(spark, sf_dir):
    """Cosines of all pairs of an episode's points of a type (VEC17)."""
    p = points(spark, sf_dir).select("id", "episode_id", "type", "clip")
    # a long episode's points meet in parts of their own: each of one side is in one part, each of the other in all
    p = p.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PAIR_PARTS)).cast("int"))
    o = p.select(F.col("id").alias("other"), "episode_id", "type", F.col("clip").alias("clip2"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_PARTS - 1))).alias("part"))
    pairs = p.join(o, ["episode_id", "type", "part"]).filter("id < other").withColumn("s", V.cosine(F.col("clip"), F.col("clip2")))
    return pairs.groupBy("type").agg(F.count("*").alias("pairs"), F.round(F.min("s"), 6).alias("lowest"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.max("s"), 6).alias("highest"))


# --- fusion


def hits(spark, sf_dir, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = points(spark, sf_dir).select("type", *fusion.HIT, "clip")
    return tuple(search.knn(p.filter(F.col("type") == kind), queries, k).drop("rank") for kind in ("frame", "region", "ocr"))


def query_tokens(spark, sf_dir, queries: DataFrame) -> DataFrame:
    """A query's words: the class name of its own vector."""
    names = M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), T.tokens(M.class_name(F.col("label"))).alias("tokens"))
    return names.join(queries.select("qid"), "qid", "left_semi")


def hub_hits(spark, sf_dir, queries: DataFrame, k: int) -> DataFrame:
    """The shared corpus: some of the local frames, and copies of them under ids of its own a minute later."""
    frames = points(spark, sf_dir).filter((F.col("type") == "frame") & (F.pmod("moment_id", F.lit(7)) == 0))
    copies = frames.withColumn("id", F.col("id") + 1_000_000).withColumn("moment_id", F.col("moment_id") + 1_000_000).withColumn("timestamp_ms", F.col("timestamp_ms") + 60_000)
    every = frames.unionByName(copies).select("type", *fusion.HIT, "clip")
    return search.knn(every, queries, k).select("qid", "type", *fusion.HIT, "score")


def fused(spark, sf_dir, queries, k=fusion.RECALL_TOP) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    frames, regions, lines = hits(spark, sf_dir, queries, k)
    return fusion.collapse(frames, regions), regions, lines, query_tokens(spark, sf_dir, queries)


def gate_all(spark, sf_dir, queries, k=fusion.RECALL_TOP) -> DataFrame:
    collapsed, regions, lines, tokens = fused(spark, sf_dir, queries, k)
    boosted = fusion.boost(collapsed, regions, tokens)
    return fusion.gated(boosted, fusion.tag_accepted(regions, tokens), fusion.ocr_accepted(lines), M.SEARCH_GATE)


def searched(spark, sf_dir, queries) -> DataFrame:
    hub = hub_hits(spark, sf_dir, queries, fusion.RECALL_TOP).filter(F.col("score") >= M.SEARCH_GATE)
    merged = fusion.merge_hub(gate_all(spark, sf_dir, queries), hub)
    return fusion.ordered(merged).select("qid", "id", "moment_id", "score", "label", "timestamp_ms", "source", F.col("rank").cast("long").alias("rank"))


TOKENS = "tokens AS (SELECT qid, list_filter(string_split(class_name, ' '), lambda t: length(t) > 2) AS toks FROM queries JOIN (SELECT id, class_name FROM points) ON id = qid)"
MATCH = """len(list_filter(list_filter(string_split(lower(label), ' '), lambda t: length(t) > 2),
  lambda a: len(list_filter(toks, lambda b: a = b OR (length(a) >= 4 AND contains(b, a)) OR (length(b) >= 4 AND contains(a, b)))) > 0)) > 0"""


def fusion_sql(queries: str, last: str, k: int = 25) -> str:
    return with_points(
        f""", {queries}, {SCORED}, {TOKENS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, type ORDER BY score DESC, id) AS r FROM scored),
  fr AS (SELECT * FROM ranked WHERE type = 'frame' AND r <= {k}), rg AS (SELECT * FROM ranked WHERE type = 'region' AND r <= {k}), oc AS (SELECT * FROM ranked WHERE type = 'ocr' AND r <= {k}),
  best AS (SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY qid, moment_id ORDER BY score DESC, id) = 1),
  ver AS (SELECT * FROM rg WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY qid, moment_id ORDER BY yolo_conf * verify_cos DESC, id) = 1),
  col AS (
    SELECT coalesce(f.qid, b.qid) AS qid, coalesce(f.id, b.moment_id) AS id, coalesce(f.moment_id, b.moment_id) AS moment_id, greatest(coalesce(f.score, -9), coalesce(b.score, -9)) AS score,
      coalesce(f.timestamp_ms, b.timestamp_ms) AS timestamp_ms, CASE WHEN f.id IS NOT NULL THEN coalesce(v.label, '') ELSE b.label END AS label,
      CASE WHEN f.id IS NOT NULL THEN coalesce(v.yolo_conf, 0.0) ELSE b.yolo_conf END AS yolo_conf, CASE WHEN f.id IS NOT NULL THEN coalesce(v.verify_cos, 0.0) ELSE b.verify_cos END AS verify_cos
    FROM fr f FULL OUTER JOIN best b ON f.qid = b.qid AND f.moment_id = b.moment_id LEFT JOIN ver v ON v.qid = coalesce(f.qid, b.qid) AND v.moment_id = coalesce(f.moment_id, b.moment_id)
  ),
  bst AS (SELECT qid, moment_id, max(yolo_conf * verify_cos) AS sure FROM rg JOIN tokens USING (qid) WHERE label <> '' AND {MATCH} GROUP BY ALL),
  boosted AS (SELECT col.* REPLACE (round(score + 0.05 * coalesce(sure, 0.0), 6) AS score) FROM col LEFT JOIN bst USING (qid, moment_id)),
  tag AS (SELECT DISTINCT qid, moment_id FROM rg JOIN tokens USING (qid) WHERE label <> '' AND verify_cos > 0 AND {MATCH}),
  ocr AS (SELECT DISTINCT qid, moment_id FROM oc WHERE score >= 0.5),
  gat AS (SELECT * FROM boosted b WHERE score >= 0.085 OR EXISTS (SELECT 1 FROM tag t WHERE t.qid = b.qid AND t.moment_id = b.moment_id) OR EXISTS (SELECT 1 FROM ocr o WHERE o.qid = b.qid AND o.moment_id = b.moment_id)),
  fleet AS (SELECT qid, id, moment_id, timestamp_ms, label, score FROM scored WHERE type = 'frame' AND moment_id % 7 = 0),
  hub AS (
    SELECT * FROM (SELECT * FROM fleet UNION ALL SELECT qid, id + 1000000, moment_id + 1000000, timestamp_ms + 60000, label, score FROM fleet)
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {k}
  ),
  merged AS (
    SELECT qid, id, moment_id, score, label, timestamp_ms, 'local' AS source FROM gat
    UNION ALL SELECT qid, id, moment_id, score, label, timestamp_ms, 'fleet' FROM hub h WHERE score >= 0.085 AND NOT EXISTS (SELECT 1 FROM gat g WHERE g.qid = h.qid AND g.id = h.id)
  )
  {last}"""
    )


@query("fus_collapse", fusion_sql(MANY, "SELECT qid, id, moment_id, score, label, yolo_conf, verify_cos FROM col"))
def fus_collapse(spark, sf_dir):
    return fused(spark, sf_dir, query_set(spark, sf_dir))[0].select("qid", "id", "moment_id", "score", "label", "yolo_conf", "verify_cos")


@query("fus_soft_boost", fusion_sql(MANY, "SELECT qid, id, score FROM boosted"))
def fus_soft_boost(spark, sf_dir):
    collapsed, regions, _, tokens = fused(spark, sf_dir, query_set(spark, sf_dir))
    return fusion.boost(collapsed, regions, tokens).select("qid", "id", "score")


@query("fus_tag_accept", fusion_sql(MANY, "SELECT * FROM tag"))
def fus_tag_accept(spark, sf_dir):
    _, regions, _, tokens = fused(spark, sf_dir, query_set(spark, sf_dir))
    return fusion.tag_accepted(regions, tokens)


@query("fus_ocr_accept", fusion_sql(MANY, "SELECT DISTINCT qid, moment_id FROM oc WHERE score >= 0.3"))
def fus_ocr_accept(spark, sf_dir):
    return fusion.ocr_accepted(fused(spark, sf_dir, query_set(spark, sf_dir))[2], 0.3)


@query("fus_gate", fusion_sql(MANY, "SELECT qid, id, score FROM gat"))
def fus_gate(spark, sf_dir):
    return gate_all(spark, sf_dir, query_set(spark, sf_dir)).select("qid", "id", "score")


@query("fus_fleet_merge", fusion_sql(MANY, "SELECT qid, id, score, source FROM merged"))
def fus_fleet_merge(spark, sf_dir):
    queries = query_set(spark, sf_dir)
    hub = hub_hits(spark, sf_dir, queries, 25).filter(F.col("score") >= M.SEARCH_GATE)
    return fusion.merge_hub(gate_all(spark, sf_dir, queries), hub).select("qid", "id", "score", "source")


@query("fus_recall_order", fusion_sql(MANY, "SELECT qid, id, timestamp_ms, row_number() OVER (PARTITION BY qid ORDER BY timestamp_ms DESC, id) AS rank FROM gat QUALIFY rank <= 5"))
def fus_recall_order(spark, sf_dir):
    out = fusion.ordered(gate_all(spark, sf_dir, query_set(spark, sf_dir)), recall_intent=True)
    return out.select("qid", "id", "timestamp_ms", F.col("rank").cast("long").alias("rank"))


TAU = 86_400_000.0


@query(
    "fus_recency",
    fusion_sql(MANY, f"SELECT qid, id, round(score * exp(-greatest(0.0, ({NOW} - timestamp_ms)::DOUBLE) / {TAU}), 6) AS damped, row_number() OVER (PARTITION BY qid ORDER BY round(score * exp(-greatest(0.0, ({NOW} - timestamp_ms)::DOUBLE) / {TAU}), 6) DESC, id) AS rank FROM gat QUALIFY rank <= 5"),
)
def fus_recency(spark, sf_dir):
    out = fusion.ordered(gate_all(spark, sf_dir, query_set(spark, sf_dir)), now_ms=F.lit(NOW), tau_ms=TAU)
    return out.select("qid", "id", fusion.freshness(F.lit(NOW), TAU).alias("damped"), F.col("rank").cast("long").alias("rank"))


LAST = "SELECT qid, id, moment_id, score, label, timestamp_ms, source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM merged QUALIFY rank <= 5"


@query("moment_search", fusion_sql(ONE, LAST))
def moment_search(spark, sf_dir):
    """The flagship: three channels, fusion, boost, gates, the shared corpus, order, five moments."""
    return searched(spark, sf_dir, one_query(spark, sf_dir))


@query("moment_search_batch", fusion_sql(MANY, LAST))
def moment_search_batch(spark, sf_dir):
    return searched(spark, sf_dir, query_set(spark, sf_dir))


@query("object_search", fusion_sql(MANY, f"SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY timestamp_ms DESC, id) AS rank FROM rg JOIN tokens USING (qid) WHERE score >= 0.085 OR {MATCH} QUALIFY rank <= 5"))
def object_search(spark, sf_dir):
    """Objects above the gate or of a fitting label, the latest five (FUS10)."""
    queries = query_set(spark, sf_dir)
    regions = hits(spark, sf_dir, queries, 25)[1].join(query_tokens(spark, sf_dir, queries), "qid")
    kept = regions.filter((F.col("score") >= M.SEARCH_GATE) | T.label_matches(F.col("label"), F.col("tokens")))
    return found(fusion.ordered(kept, recall_intent=True))


GATES = "(VALUES " + ", ".join(f"('{e}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for e, a, b, c in M.GATES) + ") g(encoder, search_gate, verify_gate, scene_gate)"


@query("fus_gates_config", with_points(f"SELECT encoder, search_gate, verify_gate, scene_gate, count(*) FILTER (verify_cos >= verify_gate) AS verified, count(*) AS regions FROM points, {GATES} WHERE type = 'region' GROUP BY ALL"))
def fus_gates_config(spark, sf_dir):
    """Each encoder's gates, and how many of the collection's regions its gate verifies (FUS17)."""
    gates = spark.createDataFrame(M.GATES, "encoder string, search_gate double, verify_gate double, scene_gate double")
    p = points(spark, sf_dir).filter("type = 'region'").crossJoin(F.broadcast(gates))  # a row for each encoder
    return p.groupBy(*gates.columns).agg(F.count_if(F.col("verify_cos") >= F.col("verify_gate")).alias("verified"), F.count("*").alias("regions"))


# --- speech and sight

TRANSCRIPTS = "trs AS (SELECT p.id, p.timestamp_ms AS start_ms, p.timestamp_ms + d.n_chars * 10 AS end_ms, d.text, p.clip FROM points p JOIN documents d ON d.doc_id = p.id WHERE p.type = 'ocr')"


def transcripts(spark, sf_dir) -> DataFrame:
    """Lines that were heard: each lasts 10 ms a character."""
    docs = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    p = points(spark, sf_dir).filter("type = 'ocr'").join(docs, "id")
    return p.select("id", F.col("timestamp_ms").alias("start_ms"), (F.col("timestamp_ms") + F.col("n_chars") * 10).alias("end_ms"), "text", "clip")


def frames_as(spark, sf_dir, side: str) -> DataFrame:
    p = points(spark, sf_dir).filter("type = 'frame'")
    return p.select(F.col("id").alias(f"{side}_id"), F.col("timestamp_ms").alias(f"{side}_start"), F.col("t_end_ms").alias(f"{side}_end"))


@query(
    "join_transcript_overlap",
    with_points(f", {TRANSCRIPTS} SELECT p.id AS frame, t.id AS transcript FROM points p JOIN trs t ON p.timestamp_ms BETWEEN t.start_ms - 1500 AND t.end_ms + 1500 WHERE p.type = 'frame'"),
)
def join_transcript_overlap(spark, sf_dir):
    t = transcripts(spark, sf_dir).select(F.col("id").alias("b_id"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return intervals.overlaps(frames_as(spark, sf_dir, "a"), t, 1500).select(F.col("a_id").alias("frame"), F.col("b_id").alias("transcript"))


#: How much longer than heard the transcripts are taken to last where their overlaps are sought.
LONGER = 2000


@query(
    "join_span_overlap",
    with_points(f", {TRANSCRIPTS}, long AS (SELECT id, start_ms, start_ms + (end_ms - start_ms) * {LONGER} AS end_ms FROM trs) SELECT a.id AS a, b.id AS b FROM long a JOIN long b ON a.start_ms - 5000 <= b.end_ms AND b.start_ms - 5000 <= a.end_ms AND a.id <> b.id"),
)
def join_span_overlap(spark, sf_dir):
    """Pairs of transcripts that overlap, widened on both sides (JON6); each is taken to last so much longer that many do."""
    t = transcripts(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * LONGER)
    side = lambda s: t.select(F.col("id").alias(f"{s}_id"), F.col("start_ms").alias(f"{s}_start"), F.col("end_ms").alias(f"{s}_end"))
    return intervals.overlaps(side("a"), side("b"), 5000, 3_600_000).filter("a_id <> b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


NEAREST = with_points(
    f""", {TRANSCRIPTS}, m AS (SELECT id, (start_ms + end_ms) // 2 AS mid FROM trs)
    SELECT m.id AS transcript, arg_min(p.id, {{'d': abs(p.timestamp_ms - mid), 't': p.timestamp_ms, 'i': p.id}}) AS frame
    FROM m LEFT JOIN points p ON p.type = 'frame' AND abs(p.timestamp_ms - mid) <= 30000 GROUP BY m.id"""
)


@query("join_nearest_frame", NEAREST)
def join_nearest_frame(spark, sf_dir):
    t = transcripts(spark, sf_dir).select(F.col("id").alias("a_id"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("a_ts"))
    f = points(spark, sf_dir).filter("type = 'frame'").select(F.col("id").alias("b_id"), F.col("timestamp_ms").alias("b_ts"))
    return intervals.nearest(t, f, 30_000).select(F.col("a_id").alias("transcript"), F.col("b_id").alias("frame"))


VISION_GATE = 0.2


@query("legacy_vision_gate", knn_sql(f"type = 'frame' AND score >= {VISION_GATE}", 3, MANY))
def legacy_vision_gate(spark, sf_dir):
    """The best three by sight, if any is good enough (FUS11)."""
    frames = hits(spark, sf_dir, query_set(spark, sf_dir), 5)[0].filter(F.col("score") >= VISION_GATE)
    return found(search.top(frames, 3))


HEARD = f""", {MANY}, {TRANSCRIPTS}, hs AS (SELECT qid, t.id, round(list_cosine_similarity(t.clip, q), 6) AS score FROM trs t, queries),
hr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k, lead(score) OVER (PARTITION BY qid ORDER BY score DESC, id) AS nxt FROM hs)"""


@query("legacy_heard_margin", with_points(f"{HEARD} SELECT qid, id, round(CASE WHEN nxt IS NULL THEN 1.0 ELSE score - nxt END, 6) AS margin FROM hr WHERE k = 1"))
def legacy_heard_margin(spark, sf_dir):
    t = transcripts(spark, sf_dir)
    return fusion.margin(search.knn(t.select("id", "clip"), query_set(spark, sf_dir), 2).drop("rank"))


@query("legacy_retrieve")
def legacy_retrieve(spark, sf_dir):
    """Cards by sight, keyword and sound, merged by picture and time, the best three (FUS13-FUS16)."""
    queries = query_set(spark, sf_dir)
    frames = search.top(hits(spark, sf_dir, queries, 5)[0].filter(F.col("score") >= VISION_GATE), 3)
    card = lambda df, start, end, path, sight, strength, said: df.select(
        "qid", "id", path.alias("path"), start.alias("start_ms"), end.alias("end_ms"), F.lit(sight).alias("vision"), F.lit(not sight).alias("heard"),
        strength.alias("strength"), said.alias("transcript"),
    )
    none = F.lit(None).cast("string")
    sight = card(frames, F.col("timestamp_ms"), F.col("timestamp_ms"), F.col("thumb_path"), True, F.col("score"), none)
    t = transcripts(spark, sf_dir)
    heard = search.knn(t.select("id", "start_ms", "end_ms", "text", "clip"), queries, 2)
    sure = fusion.margin(heard.drop("rank")).filter(F.col("margin") >= 0.10).select("qid", "id")
    sound = card(heard.join(sure, ["qid", "id"]), F.col("start_ms"), F.col("end_ms"), F.lit(""), False, F.col("score"), F.col("text"))
    words = scan.keyword_hits(t, "text", "Licensed")
    keyed = card(search.against(words, queries.select("qid")), F.col("start_ms"), F.col("end_ms"), F.lit(""), False, F.lit(1.0), F.col("text"))
    first = card(search.top(heard.drop("rank"), 1), F.col("start_ms"), F.col("end_ms"), F.lit(""), False, F.col("score"), F.col("text"))
    out = fusion.annotated(fusion.merge_cards(sight.unionByName(sound).unionByName(keyed)), first.unionByName(keyed))
    return out.select("qid", "id", "start_ms", "end_ms", "vision", "heard", "strength", F.col("rank").cast("long").alias("rank"))


# --- evaluation


@query(
    "eval_recall",
    with_points(
        f""", {MANY}, {SCORED}, t AS (SELECT qid, id FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
        c AS (SELECT p.id, p.clip, qid, q, bit_count(xor({CODE.format(v='p.clip')}, {CODE.format(v='q')})) AS apart FROM points p, queries),
        g0 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY apart, id) <= 160),
        g AS (SELECT qid, id FROM g0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(clip, q), 6) DESC, id) <= 5),
        r AS (SELECT t.qid, count(g.id) / count(*)::DOUBLE AS share FROM t LEFT JOIN g ON g.qid = t.qid AND g.id = t.id GROUP BY t.qid)
        SELECT round(avg(share), 6) AS recall, count(*) AS queries FROM r"""
    ),
)
def eval_recall(spark, sf_dir):
    p, q = places(points(spark, sf_dir)), query_set(spark, sf_dir)
    return search.recall(search.knn(p, q), search.binary(p, q))


CELL = "list_sum(list_transform(range(1, 5), lambda i: CASE WHEN {v}[i] > 0 THEN 1 << (i - 1) ELSE 0 END))::BIGINT"


@query(
    "eval_cell_recall",
    with_points(
        f""", {MANY}, {SCORED}, t AS (SELECT qid, id FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
        apart AS (SELECT s.qid, s.id, s.score, bit_count(xor({CELL.format(v='s.clip')}, {CELL.format(v='q.q')})) AS bits FROM scored s JOIN queries q USING (qid)),
        d AS (SELECT unnest(range(5)) AS differing),
        g AS (SELECT differing, qid, id FROM apart, d WHERE bits <= differing QUALIFY row_number() OVER (PARTITION BY differing, qid ORDER BY score DESC, id) <= 5),
        r AS (SELECT d.differing, t.qid, count(g.id) / count(*)::DOUBLE AS share FROM d CROSS JOIN t LEFT JOIN g ON g.differing = d.differing AND g.qid = t.qid AND g.id = t.id GROUP BY ALL)
        SELECT differing::INT AS differing, round(avg(share), 6) AS recall, count(*) AS queries FROM r GROUP BY differing"""
    ),
)
def eval_cell_recall(spark, sf_dir):
    """Recall of the search in parts by how many bits a cell may differ (EVL8, VEC11, VEC12)."""
    p, q = places(points(spark, sf_dir)), query_set(spark, sf_dir)
    truth = search.knn(p, q)
    parts = [search.recall(truth, search.cell_search(p, q, differing=d)).withColumn("differing", F.lit(d)) for d in range(5)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def lists_sql(rest: str) -> str:
    """The index's lists in SQL: spherical k-means from evenly spaced points, ``assigned`` (id, clip, list) and ``looked`` (qid, q, list, place)."""
    near = "FROM numbered n, {c} c QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY round(list_dot_product(n.v, c.v), 9) DESC, c.list) = 1"
    steps = []
    for k in range(ann.ROUNDS):
        steps.append(f"own{k} AS (SELECT n.id, n.v, c.list {near.format(c=f'centres{k}')})")
        steps.append(f"sums{k} AS (SELECT list, list(s ORDER BY d) AS v FROM (SELECT list, d, sum(x) AS s FROM (SELECT list, unnest(v) AS x, unnest(range(len(v))) AS d FROM own{k}) GROUP BY ALL) GROUP BY list)")
        steps.append(f"centres{k + 1} AS (SELECT c.list, coalesce(list_transform(s.v, lambda x: x / sqrt(list_dot_product(s.v, s.v))), c.v) AS v FROM centres{k} c LEFT JOIN sums{k} s ON s.list = c.list)")
    last = f"centres{ann.ROUNDS}"
    return with_points(
        f""", {MANY}, {SCORED}, numbered AS (SELECT id, clip, list_transform(clip, lambda x: x / sqrt(list_dot_product(clip, clip))) AS v, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM points),
        size AS (SELECT greatest(1, round(sqrt(count(*))))::BIGINT AS lists, count(*) // greatest(1, round(sqrt(count(*))))::BIGINT AS step FROM points),
        centres0 AS (SELECT k // step AS list, v FROM numbered, size WHERE k % step = 0 AND k // step < lists), {', '.join(steps)},
        assigned AS (SELECT n.id, n.clip, c.list {near.format(c=last)}),
        looked AS (SELECT qid, q, list, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))), c.v), 9) DESC, list) AS place FROM queries, {last} c)
        {rest}"""
    )


def index(spark: SparkSession, sf_dir: str) -> ann.Index:
    """A new index over the whole collection."""
    p = points(spark, sf_dir).select("id", "type", "timestamp_ms", "label", F.col("clip").cast("array<float>").alias("clip"))
    return ann.Index.build(p, run.shared_folder(spark))


#: Lists that a query looks into: about a quarter of those of 500 points.
LOOKED = 6


@query(
    "vec_ann_lists",
    lists_sql(
        f"""SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
        FROM (SELECT l.qid, a.id, round(list_cosine_similarity(a.clip, l.q), 6) AS score FROM assigned a JOIN looked l ON l.list = a.list AND l.place <= {LOOKED})) WHERE rank <= 5"""
    ),
)
def vec_ann_lists(spark, sf_dir):
    """The best of the nearest lists of a trained index, scored exactly (VEC11, VEC12)."""
    return found(index(spark, sf_dir).search_lists(query_set(spark, sf_dir), 5, LOOKED))


@query("vec_ann_filtered", lists_sql(f"""SELECT qid, id, score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
        FROM (SELECT l.qid, a.id, round(list_cosine_similarity(a.clip, l.q), 6) AS score FROM assigned a JOIN looked l ON l.list = a.list AND l.place <= {LOOKED} JOIN points p ON p.id = a.id
        WHERE p.timestamp_ms BETWEEN {SINCE} AND {UNTIL})) WHERE rank <= 5"""))
def vec_ann_filtered(spark, sf_dir):
    """The filter stands before the cut, so as many come back as the lists have (VEC12)."""
    return found(index(spark, sf_dir).search_lists(query_set(spark, sf_dir), 5, LOOKED, scan.in_window(SINCE, UNTIL)))


@query("vec_ann_codes")
def vec_ann_codes(spark, sf_dir):
    """All lists by their bytes, a fortieth of the points rescored (VEC11, VEC12); tests hold it against exact search."""
    return found(index(spark, sf_dir).search(query_set(spark, sf_dir), 5, ann.LISTS, 50))


@query(
    "eval_ann_recall",
    lists_sql(
        """, t AS (SELECT qid, id FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
        w AS (SELECT unnest([8, 4, 2, 1]) AS part), n AS (SELECT part, greatest(1, lists // part) AS probes FROM w, size),
        near AS (SELECT probes, l.qid, a.id, round(list_cosine_similarity(a.clip, l.q), 6) AS score FROM n JOIN looked l ON l.place <= probes JOIN assigned a ON a.list = l.list),
        g AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY probes, qid ORDER BY score DESC, id) <= 5),
        r AS (SELECT n.probes, t.qid, count(g.id) / count(*)::DOUBLE AS share FROM n CROSS JOIN t LEFT JOIN g ON g.probes = n.probes AND g.qid = t.qid AND g.id = t.id GROUP BY ALL)
        SELECT probes::INT AS probes, round(avg(share), 6) AS recall, (SELECT round(count(*)::DOUBLE / (SELECT count(*) FROM queries) / (SELECT count(*) FROM points), 6) FROM near WHERE near.probes = r.probes) AS points_read FROM r GROUP BY probes"""
    ),
)
def eval_ann_recall(spark, sf_dir):
    """Recall of the trained lists by how many a query looks into, and the share of points that it reads (EVL8, VEC11, VEC12)."""
    p, q, made = places(points(spark, sf_dir)), query_set(spark, sf_dir), index(spark, sf_dir)
    truth, model = search.knn(p, q), made.quantiser()
    lists = len(model.centres)
    sizes = np.zeros(lists, np.int64)
    for r in made.points().groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list
        sizes[r["list"]] = r["n"]
    parts = []
    for part in (8, 4, 2, 1):
        probes = max(1, lists // part)
        # the share that each query reads follows from the sizes of its lists
        read = [n for _, m in made._blocks(q) for n in sizes[model.probes(m, probes)].sum(1).tolist()]
        share = round(sum(read) / max(len(read), 1) / max(int(sizes.sum()), 1), 6)
        parts.append(search.recall(truth, made.search_lists(q, 5, probes)).select(F.lit(probes).alias("probes"), "recall", F.lit(share).alias("points_read")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("eval_sweep", with_points(f""", {MANY}, {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM scored),
        w AS (SELECT * FROM r WHERE timestamp_ms BETWEEN {SINCE} AND {UNTIL}), t AS (SELECT qid, id FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
        c AS (SELECT unnest([10, 50, 200]) AS candidates), g AS (SELECT candidates, qid, id FROM w, c WHERE k <= candidates QUALIFY row_number() OVER (PARTITION BY candidates, qid ORDER BY score DESC, id) <= 5),
        s AS (SELECT c.candidates, t.qid, count(g.id) / count(*)::DOUBLE AS share FROM c, t LEFT JOIN g ON g.candidates = c.candidates AND g.qid = t.qid AND g.id = t.id GROUP BY ALL)
        SELECT candidates::BIGINT AS candidates, round(avg(share), 6) AS recall FROM s GROUP BY candidates"""))
def eval_sweep(spark, sf_dir):
    """What filtering after the search costs, by the number of candidates (EVL8)."""
    # no more than the most candidates of each query are ranked, beside the best of the window
    p, q = points(spark, sf_dir).select("id", "timestamp_ms", "clip"), query_set(spark, sf_dir)
    inside = search.knn(p, q, 200).filter(scan.in_window(SINCE, UNTIL)).withColumnRenamed("rank", "k")
    truth = search.knn(p.filter(scan.in_window(SINCE, UNTIL)).select("id", "clip"), q).groupBy("qid").agg(F.collect_set("id").alias("t"))
    sizes = spark.createDataFrame([(10,), (50,), (200,)], "candidates bigint")
    w = Window.partitionBy("candidates", "qid").orderBy(F.desc("score"), "id")
    got = inside.join(F.broadcast(sizes), F.col("k") <= F.col("candidates")).withColumn("r", F.row_number().over(w)).filter("r <= 5")
    got = got.groupBy("candidates", "qid").agg(F.collect_set("id").alias("g"))
    both = truth.crossJoin(F.broadcast(sizes)).join(got, ["candidates", "qid"], "left")
    share = F.size(F.array_intersect("t", F.coalesce("g", F.array().cast("array<bigint>")))) / F.size("t")
    return both.groupBy("candidates").agg(F.round(F.avg(share), 6).alias("recall"))


@query(
    "eval_ab",
    f"""WITH {MANY}, s AS (SELECT qid, e.label AS own, r.label AS want, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q), 6) AS score FROM embeddings e, queries JOIN embeddings r ON r.vec_id = qid WHERE e.vec_id <> qid),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s),
    p AS (SELECT qid, max(CASE WHEN rank = 1 AND own = want THEN 1.0 ELSE 0.0 END) AS first, max(CASE WHEN rank <= 3 AND own = want THEN 1.0 ELSE 0.0 END) AS third,
      avg(score) FILTER (own = want) - avg(score) FILTER (own <> want) AS margin, max(score) FILTER (own <> want) AS floor FROM k GROUP BY qid)
    SELECT round(avg(first), 6) AS top1, round(avg(third), 6) AS recall3, round(avg(margin), 6) AS margin, round(avg(floor), 6) AS absent_floor FROM p""",
)
def eval_ab(spark, sf_dir):
    """Top one, recall at three, and how far the right ones are above the wrong (EVL6)."""
    e = M.table(spark, sf_dir, "embeddings")
    q = query_set(spark, sf_dir).join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("want")), "qid")
    p = e.select(F.col("vec_id").alias("id"), F.col("label").alias("own"), F.col("embedding").alias("clip"))
    # the best three of each query; all others only add to means
    right = F.col("own") == F.col("want")
    one = lambda most: F.max(F.when((F.col("rank") <= most) & right, 1.0).otherwise(0.0))
    best = search.top(pairs.nearest(p.filter("id IS NOT NULL"), q, 3, other=True), 3).join(q.select("qid", "want"), "qid")
    first = best.groupBy("qid").agg(one(1).alias("first"), one(3).alias("third"))
    means = pairs.means(p.filter("id IS NOT NULL"), q, "own", "want")
    per = first.join(means, "qid")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return per.agg(mean("first", "top1"), mean("third", "recall3"), mean("margin", "margin"), mean("floor", "absent_floor"))


@query(
    "eval_verify_bands",
    """WITH a AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
    s AS (SELECT e.label = a.label AS right, list_cosine_similarity(e.embedding::DOUBLE[], a.v) AS c FROM embeddings e, a)
    SELECT round(min(c) FILTER (right), 6) AS lowest_right, round(avg(c) FILTER (right), 6) AS mean_right, round(max(c) FILTER (NOT right), 6) AS highest_wrong, round(avg(c) FILTER (NOT right), 6) AS mean_wrong,
    round((avg(c) FILTER (right) + avg(c) FILTER (NOT right)) / 2, 6) AS middle FROM s""".replace("AS right", "AS ok").replace("(right)", "(ok)").replace("NOT right", "NOT ok"),
)
def eval_verify_bands(spark, sf_dir):
    e = M.table(spark, sf_dir, "embeddings")
    anchors = e.groupBy(F.col("label").alias("other")).agg(F.min_by("embedding", "vec_id").alias("v"))
    s = search.against(e, anchors.withColumn("qid", F.col("other"))).select((F.col("label") == F.col("other")).alias("ok"), V.cosine(F.col("embedding"), F.col("v")).alias("c"))
    right, wrong = F.when(F.col("ok"), F.col("c")), F.when(~F.col("ok"), F.col("c"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return s.agg(r(F.min(right), "lowest_right"), r(F.avg(right), "mean_right"), r(F.max(wrong), "highest_wrong"), r(F.avg(wrong), "mean_wrong"), r((F.avg(right) + F.avg(wrong)) / 2, "middle"))


@query(
    "eval_integrity",
    with_points(f", {ONE}, {SCORED} SELECT (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM points) AS stored, (SELECT count(*) >= 5 FROM scored) AS enough, (SELECT count(*) > 0 FROM scored WHERE timestamp_ms BETWEEN {SINCE} AND {UNTIL}) AS inside"),
)
def eval_integrity(spark, sf_dir):
    """What must hold after a load (EVL2)."""
    p = points(spark, sf_dir)
    stored = p.agg(F.count("*").alias("n"), F.count_if(scan.in_window(SINCE, UNTIL)).alias("w"))
    vectors = M.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("m"))
    return stored.crossJoin(vectors).select((F.col("n") == F.col("m")).alias("stored"), (F.col("n") >= 5).alias("enough"), (F.col("w") > 0).alias("inside"))


@query(
    "stats_median_p90",
    "SELECT event_type, s[len(s) // 2 + 1] AS median, s[len(s) * 9 // 10 + 1] AS p90, s[1] AS lowest, s[len(s)] AS highest, round(list_avg(s), 6) AS mean FROM (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type)",
)
def stats_median_p90(spark, sf_dir):
    """The upper median and the value at nine tenths of the sorted list (AGG5, AGG6), by rank; no task sorts a whole group."""
    e = M.table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_type", "value", "event_id")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.round(F.avg("value"), 6).alias("mean"))
    k = numbered(e, ["event_type"], ["value", "event_id"]).join(sums, "event_type")
    at = lambda place: F.max(F.when(F.col("k") == place + 1, F.col("value")))
    n = F.col("n")
    picked = k.filter((F.col("k") == F.floor(n / 2) + 1) | (F.col("k") == F.floor(n * 9 / 10) + 1))
    return picked.groupBy("event_type", "lowest", "highest", "mean").agg(at(F.floor(n / 2)).alias("median"), at(F.floor(n * 9 / 10)).alias("p90")).select("event_type", "median", "p90", "lowest", "highest", "mean")


@query(
    "stats_running_mean",
    "SELECT user_id, k, round(m, 6) AS mean FROM (SELECT user_id, row_number() OVER w AS k, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE k % 10 = 0",
)
def stats_running_mean(spark, sf_dir):
    """A mean after every ten values (AGG7)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = M.table(spark, sf_dir, "events")
    e = e.select("user_id", F.row_number().over(w).cast("long").alias("k"), F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    return e.filter("k % 10 = 0").select("user_id", "k", F.round("m", 6).alias("mean"))


@query("agg_regions_list", with_points("SELECT moment_id, list(id ORDER BY id) AS regions, count(*) AS n FROM points WHERE type = 'region' GROUP BY moment_id"))
def agg_regions_list(spark, sf_dir):
    p = points(spark, sf_dir).filter("type = 'region'")
    return p.groupBy("moment_id").agg(F.array_sort(F.collect_list("id")).alias("regions"), F.count("*").alias("n"))


@query("agg_best_region", with_points("SELECT moment_id, arg_max(id, {'s': verify_cos, 'i': -id}) AS best, arg_max(id, {'s': yolo_conf * verify_cos, 'i': -id}) FILTER (label <> '') AS verified FROM points WHERE type = 'region' GROUP BY moment_id"))
def agg_best_region(spark, sf_dir):
    """The best of each group, and the best of those that fulfil a condition; of equal ones the first (AGG1, AGG2)."""
    p = points(spark, sf_dir).filter("type = 'region'")
    named = F.col("label") != ""
    sure = F.struct(F.col("yolo_conf") * F.col("verify_cos"), -F.col("id"))
    return p.groupBy("moment_id").agg(F.max_by("id", F.struct("verify_cos", -F.col("id"))).alias("best"), F.max_by(F.when(named, F.col("id")), F.when(named, sure)).alias("verified"))


@query("agg_session_counter", "SELECT user_id, count(*) AS indexed, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) // 1000 AS elapsed_s FROM events GROUP BY user_id")
def agg_session_counter(spark, sf_dir):
    e = M.table(spark, sf_dir, "events").select("user_id", M.epoch_ms(F.col("ts")).alias("t"))
    return e.groupBy("user_id").agg(F.count("*").alias("indexed"), F.floor((F.max("t") - F.min("t")) / 1000).cast("long").alias("elapsed_s"))


@query("agg_concat_texts", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def agg_concat_texts(spark, sf_dir):
    c = M.table(spark, sf_dir, "conversations").filter(F.trim("text") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(F.array_join(ordered, " ").alias("text"))


@query("set_disappeared", with_points("SELECT episode_id FROM points WHERE type = 'frame' EXCEPT SELECT episode_id FROM points WHERE type = 'region' AND label <> ''"))
def set_disappeared(spark, sf_dir):
    """Keys of one set that the other lacks (SET4)."""
    p = points(spark, sf_dir)
    return p.filter("type = 'frame'").select("episode_id").subtract(p.filter("type = 'region' AND label <> ''").select("episode_id"))


@query("set_union_ids", with_points("SELECT moment_id FROM points WHERE type = 'frame' UNION SELECT moment_id FROM points WHERE label <> ''"))
def set_union_ids(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.filter("type = 'frame'").select("moment_id").union(p.filter("label <> ''").select("moment_id")).distinct()


@query("set_distinct_by_key", with_points("SELECT id, episode_id, timestamp_ms FROM points QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY id) = 1"))
def set_distinct_by_key(spark, sf_dir):
    """The first row of each key (SET3); an aggregate, so a key of very many rows is reduced before it is shuffled."""
    p = points(spark, sf_dir)
    return p.groupBy("episode_id").agg(F.min(F.struct("id", "timestamp_ms")).alias("f")).select("f.id", "episode_id", "f.timestamp_ms")
