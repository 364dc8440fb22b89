"""Entry points for a question in words: parse, embed, search, answer."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import querytext as T
from ..operators import fusion, scan, search
from ..sources.encoders import Encoder
from ..sources.moments import SEARCH_GATE
from ..sources.store import FRAME, REGION, MomentStore


@dataclass
class Outcome:
    """Cards of a search that worked, maybe none; or why it could not be done, which is something else."""

    cards: list[Row] = field(default_factory=list)
    unavailable: str | None = None


def parsed(store: MomentStore, raw: str, now_ms: int) -> Row:
    return store.spark.createDataFrame([(raw, now_ms)], "q string, now long").select(T.parse(F.col("q"), F.col("now")).alias("p")).first().p


class MomentSearcher:
    """``encode`` makes query vectors of the frames' space, ``encode_text`` of the texts' space; the hub is a second store."""

    def __init__(self, store: MomentStore, encode: Encoder, encode_text: Encoder | None = None, hub: MomentStore | None = None, gate: float = SEARCH_GATE):
        self.store, self.encode, self.encode_text, self.hub, self.gate = store, encode, encode_text, hub, gate

    def search(self, raw: str, now_ms: int, tau_ms: float = 0.0) -> Outcome:
        if len(raw.strip()) < 2:
            return Outcome()
        try:
            p = parsed(self.store, raw, now_ms)
            if p.time_only:
                return Outcome(self.store.frames_in_window(p.since_ms, p.until_ms, fusion.TOP).collect())
            return Outcome(self._ranked(p, now_ms, tau_ms).orderBy("rank").collect())
        except Exception as e:  # a store or an encoder that fails isn't an empty answer
            return Outcome(unavailable=f"{type(e).__name__}: {str(e)[:200]}")

    def _ranked(self, p: Row, now_ms: int, tau_ms: float) -> DataFrame:
        spark, k = self.store.spark, fusion.RECALL_TOP if p.recall_intent else fusion.TOP
        vector = self.encode([p.embed_text])[0]
        q = spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, q array<double>")
        words = spark.createDataFrame([(0, p.embed_text)], "qid long, t string").select("qid", T.tokens(F.col("t")).alias("tokens"))
        points = self.store.points().filter(scan.in_window(p.since_ms, p.until_ms))
        frames, regions = (search.knn(points.filter(F.col("type") == kind), q, k).drop("rank") for kind in (FRAME, REGION))
        hits = fusion.boost(fusion.collapse(frames, regions), regions, words)
        nothing = hits.select("qid", "moment_id").limit(0)
        try:  # reading texts is a help, never a condition
            lines = self.store.search_text(self.encode_text([p.embed_text])[0], k, p.since_ms, p.until_ms) if self.encode_text else None
        except Exception:
            lines = None
        ocr = nothing if lines is None else fusion.ocr_accepted(lines)
        merged = fusion.gated(hits, fusion.tag_accepted(regions, words), ocr, self.gate).withColumn("source", F.lit("local"))
        if self.hub is not None:
            shared = search.knn(self.hub.points().filter(scan.in_window(p.since_ms, p.until_ms)), q, k).filter(F.col("score") >= self.gate)
            merged = fusion.merge_hub(merged.drop("source"), shared.select("qid", "type", *fusion.HIT, "score"))
        return fusion.ordered(merged, p.recall_intent, F.lit(now_ms), tau_ms)


def repository_search(store: MomentStore, phrase: str, encode: Encoder | None, since: int | None = None, until: int | None = None, label: str | None = None, k: int = 20) -> DataFrame:
    """By vector if there are words and an encoder, else by time, newest first; the label is compared again without case (FUS18, FLT9)."""
    points = scan.of_type(store.points(), FRAME, since, until, label)
    if phrase.strip() and encode is not None:
        q = store.spark.createDataFrame([(0, [float(x) for x in encode([phrase])[0]])], "qid long, q array<double>")
        found = search.knn(points, q, k)
    else:
        found = scan.newest(points, 50)
    return found.filter(F.lower("label") == label.lower()) if label else found


def answer(hits: list[Row], written: str | None = None) -> str:
    """A model's answer if it gave one; else the number of hits, so a turn is never empty (STR-r)."""
    if written and written.strip():
        return written
    return f"Нашёл {len(hits)}." if hits else "Ничего не нашёл."
