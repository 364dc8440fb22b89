"""Ranking moments from the hits of several channels (FUS, JON1-JON4).

Hits have ``qid`` and the columns of a point with ``score``; everything works for many queries at once, keyed by ``qid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.querytext import label_matches
from .search import top

BOOST, OCR_GATE, TOP, RECALL_TOP = 0.05, 0.5, 5, 25
DIGITS = 6
HIT = ["id", "moment_id", "timestamp_ms", "thumb_path", "label", "bbox", "yolo_conf", "verify_cos"]


def collapse(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """One row for each moment: a frame's identity, the best score of all, the label of its best verified region; a moment of regions alone
    is its best region, shown as a frame (FUS1)."""
    order = F.struct((-F.col("score")).alias("s"), "id")
    sure = F.struct((-F.col("yolo_conf") * F.col("verify_cos")).alias("s"), "id")
    named = F.col("label") != ""
    best = regions.groupBy("qid", "moment_id").agg(
        F.min_by(F.struct(*HIT, "score"), order).alias("r"),
        F.min_by(F.when(named, F.struct("label", "yolo_conf", "verify_cos")), F.when(named, sure)).alias("v"),
    )
    f = frames.select("qid", "moment_id", F.struct(*HIT, "score").alias("f"))
    both = f.join(best, ["qid", "moment_id"], "full_outer")
    seen = F.col("f").isNotNull()
    either = lambda c: F.when(seen, F.col(f"f.{c}")).otherwise(F.col(f"r.{c}"))
    told = lambda c, zero: F.when(seen, F.coalesce(F.col(f"v.{c}"), zero)).otherwise(F.col(f"r.{c}"))
    return both.select(
        "qid",
        F.when(seen, F.col("f.id")).otherwise(F.col("moment_id")).alias("id"),
        "moment_id",
        F.lit("frame").alias("type"),
        F.greatest(F.col("f.score"), F.col("r.score")).alias("score"),
        either("timestamp_ms").alias("timestamp_ms"),
        either("thumb_path").alias("thumb_path"),
        told("label", F.lit("")).alias("label"),
        either("bbox").alias("bbox"),
        told("yolo_conf", F.lit(0.0)).alias("yolo_conf"),
        told("verify_cos", F.lit(0.0)).alias("verify_cos"),
    )


def boost(hits: DataFrame, regions: DataFrame, tokens: DataFrame, factor: float = BOOST) -> DataFrame:
    """Add ``factor`` times the certainty of the moment's best region whose label is in the query (FUS2).  ``tokens``: ``qid``, ``tokens``."""
    fits = regions.join(tokens, "qid").filter((F.col("label") != "") & label_matches(F.col("label"), F.col("tokens")))
    best = fits.groupBy("qid", "moment_id").agg(F.max(F.col("yolo_conf") * F.col("verify_cos")).alias("sure"))
    return hits.join(best, ["qid", "moment_id"], "left").withColumn("score", F.round(F.col("score") + factor * F.coalesce("sure", F.lit(0.0)), DIGITS)).drop("sure")


def tag_accepted(regions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Moments that a verified label of the query accepts (FUS3)."""
    fits = regions.join(tokens, "qid")
    fits = fits.filter((F.col("label") != "") & (F.col("verify_cos") > 0) & label_matches(F.col("label"), F.col("tokens")))
    return fits.select("qid", "moment_id").distinct()


def ocr_accepted(lines: DataFrame, gate: float = OCR_GATE) -> DataFrame:
    """Moments that a read text accepts (FUS4)."""
    return lines.filter(F.col("score") >= gate).select("qid", "moment_id").distinct()


def gated(hits: DataFrame, tags: DataFrame, ocr: DataFrame, gate: float) -> DataFrame:
    """Hits above the gate or accepted by a tag or a text; acceptance brings in no moment of its own (FUS5)."""
    accepted = tags.unionByName(ocr).distinct().withColumn("__ok", F.lit(True))
    kept = hits.join(accepted, ["qid", "moment_id"], "left")
    return kept.filter((F.col("score") >= gate) | F.col("__ok")).drop("__ok")


def merge_hub(local: DataFrame, hub: DataFrame) -> DataFrame:
    """Both corpora; of an id that both have the local hit stays, with its score (FUS6)."""
    both = local.withColumn("source", F.lit("local")).unionByName(hub.withColumn("source", F.lit("fleet")), allowMissingColumns=True)
    w = Window.partitionBy("qid", "id").orderBy(F.desc("source"))
    return both.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def freshness(now_ms: Column, tau_ms: float) -> Column:
    """A score damped by age; times in the future count as now (FUS8)."""
    return F.round(F.col("score") * F.exp(-F.greatest(F.lit(0.0), (now_ms - F.col("timestamp_ms")).cast("double")) / tau_ms), DIGITS)


def ordered(hits: DataFrame, recall_intent: bool = False, now_ms: Column | None = None, tau_ms: float = 0.0, take: int = TOP) -> DataFrame:
    """The first ``take`` of each query: by time for "where did I leave", by damped score if there is a ``tau_ms``, else by score (FUS7)."""
    first = F.desc("timestamp_ms") if recall_intent else F.desc("__s")
    kept = hits.withColumn("__s", freshness(now_ms, tau_ms) if tau_ms > 0 else F.col("score"))
    w = Window.partitionBy("qid").orderBy(first, "id")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= take).drop("__s")


def margin(hits: DataFrame) -> DataFrame:
    """First score minus second; 1 if there is one hit only (FUS12)."""
    w = Window.partitionBy("qid").orderBy("rank")
    best = top(hits, 2)  # each task keeps its own two
    pair = best.select("qid", "id", "score", F.lead("score").over(w).alias("next"), "rank").filter("rank = 1")
    return pair.select("qid", "id", F.round(F.when(F.col("next").isNull(), 1.0).otherwise(F.col("score") - F.col("next")), DIGITS).alias("margin"))


CARD = "id bigint, path string, start_ms bigint, end_ms bigint, vision boolean, heard boolean, strength double, transcript string"


def merge_cards(cards: DataFrame, slack_ms: int = 5000, take: int = 3) -> DataFrame:
    """Cards of the same picture or of overlapping times become one, strongest first (FUS14, FUS16).

    ``cards`` has ``qid`` and the fields of ``CARD``.  A query has a handful of cards (three by sight, five by keyword, one heard), so each
    query's are folded in one array.
    """
    each = cards.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("o"), "id", "path", "start_ms", "end_ms", "vision", "heard", "strength", "transcript"))).alias("c"))
    kind = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in CARD.split(', '))}>>"

    def near(m: Column, c: Column) -> Column:
        same = (m["path"] != "") & (m["path"] == c["path"])
        return same | ((m["start_ms"] - slack_ms <= c["end_ms"]) & (c["start_ms"] - slack_ms <= m["end_ms"]))

    def step(acc: Column, c: Column) -> Column:
        place = F.get(F.filter(F.transform(acc, lambda m, i: F.when(near(m, c), i)), lambda i: i.isNotNull()), F.lit(0))
        shown = lambda m: m["transcript"].isNull() & c["transcript"].isNotNull()

        def joined(m: Column) -> Column:
            pick = lambda n: F.when(shown(m), c[n]).otherwise(m[n]).alias(n)
            return F.struct(
                pick("id"), pick("path"), pick("start_ms"), pick("end_ms"), (m["vision"] | c["vision"]).alias("vision"), (m["heard"] | c["heard"]).alias("heard"),
                F.round(m["strength"] + c["strength"], DIGITS).alias("strength"), pick("transcript"),
            )

        fresh = F.struct(*[c[x.split(" ")[0]].alias(x.split(" ")[0]) for x in CARD.split(", ")])
        return F.when(place.isNull(), F.concat(acc, F.array(fresh))).otherwise(F.transform(acc, lambda m, i: F.when(i == place, joined(m)).otherwise(m))).cast(kind)

    merged = each.select("qid", F.explode(F.aggregate("c", F.array().cast(kind), step)).alias("m")).select("qid", "m.*")
    w = Window.partitionBy("qid").orderBy(F.desc("strength"), "id")
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= take)


def annotated(cards: DataFrame, heard: DataFrame, slack_ms: int = 5000) -> DataFrame:
    """``cards`` marked as heard where a heard line (``qid``, ``path``, ``start_ms``, ``end_ms``) is of the same picture or time; no card is added (FUS15)."""
    lines = heard.groupBy("qid").agg(F.collect_list(F.struct("path", "start_ms", "end_ms")).alias("lines"))  # six at most: five by keyword and the best

    def meets(x: Column) -> Column:
        same = (x["path"] != "") & (x["path"] == F.col("path"))
        return same | ((x["start_ms"] - slack_ms <= F.col("end_ms")) & (F.col("start_ms") - slack_ms <= x["end_ms"]))

    return cards.join(lines, "qid", "left").withColumn("heard", F.col("heard") | F.coalesce(F.exists("lines", meets), F.lit(False))).drop("lines")
