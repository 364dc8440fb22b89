"""Cases of fusion, gates and order, as small tables."""

import pytest
from pyspark.sql import functions as F

from recollect.operators import fusion
from recollect.sources import moments as M

HIT = "qid long, id long, moment_id long, timestamp_ms long, thumb_path string, label string, bbox string, yolo_conf double, verify_cos double, score double"


def hits(spark, *rows):
    return spark.createDataFrame([(0, i, m, ts, f"/{m}.jpg", label, "", conf, cos, score) for i, m, score, label, conf, cos, ts in rows], HIT)


def hit(i, m, score, label="", conf=0.0, cos=0.0, ts=0):
    return (i, m, score, label, conf, cos, ts)


def tokens(spark, *words):
    return spark.createDataFrame([(0, list(words))], "qid long, tokens array<string>")


def test_frame_takes_the_best_score_of_its_regions(spark):
    out = fusion.collapse(hits(spark, hit(1, 1, 0.30)), hits(spark, hit(2, 1, 0.50, "cup", 0.5, 0.5), hit(3, 1, 0.20, "mug", 0.5, 0.1))).collect()
    assert [(r.id, r.type, r.score, r.label) for r in out] == [(1, "frame", 0.50, "cup")]


def test_moment_of_regions_alone_is_shown_as_a_frame(spark):
    out = fusion.collapse(hits(spark).limit(0), hits(spark, hit(5, 2, 0.40, "lamp", 0.8, 0.5), hit(6, 2, 0.35, "lamp", 0.1, 0.1))).first()
    assert (out.id, out.type, out.score, out.label, out.yolo_conf) == (2, "frame", 0.40, "lamp", 0.8)


def test_label_of_the_surest_region_and_score_of_the_best(spark):
    out = fusion.collapse(hits(spark, hit(1, 1, 0.1)), hits(spark, hit(2, 1, 0.50, "", 0.5, 0.1), hit(3, 1, 0.45, "cup", 0.9, 0.8))).first()
    assert (out.score, out.label, out.yolo_conf, out.verify_cos) == (0.50, "cup", 0.9, 0.8)


def test_boost(spark):
    regions = hits(spark, hit(2, 1, 0.2, "cup", 0.9, 0.8), hit(4, 3, 0.2, "", 0.9, 0.9))
    out = {r.moment_id: r.score for r in fusion.boost(hits(spark, hit(1, 1, 0.30), hit(3, 3, 0.30)), regions, tokens(spark, "cup")).collect()}
    assert out == {1: round(0.30 + 0.05 * 0.9 * 0.8, 6), 3: 0.30}


def test_tags_accept_by_verified_fitting_labels(spark):
    regions = hits(spark, hit(1, 1, 0.1, "cell phone", 0.5, 0.5), hit(2, 2, 0.1, "cell phone", 0.5, 0.0), hit(3, 3, 0.1, "", 0.5, 0.5), hit(4, 4, 0.1, "dog", 0.5, 0.5))
    assert [r.moment_id for r in fusion.tag_accepted(regions, tokens(spark, "phone")).collect()] == [1]


def test_gate_or_accept(spark):
    gate = M.SEARCH_GATE
    merged = hits(spark, hit(1, 1, gate + 0.05), hit(2, 2, gate * 0.5), hit(3, 3, gate * 0.3))
    tags = spark.createDataFrame([(0, 3), (0, 9)], "qid long, moment_id long")
    out = fusion.gated(merged, tags, tags.limit(0), gate)
    assert sorted(r.id for r in out.collect()) == [1, 3]  # acceptance brings in no moment of its own


def test_recency(spark):
    now, minute = 10_000_000, 60_000
    h = hits(spark, hit(1, 1, 0.30, ts=now - 30 * minute), hit(2, 2, 0.28, ts=now - minute), hit(3, 3, 0.10, ts=now + minute))
    out = fusion.ordered(h, now_ms=F.lit(now), tau_ms=10.0 * minute).orderBy("rank")
    assert [r.id for r in out.collect()] == [2, 3, 1]


def test_recall_intent_orders_by_time(spark):
    h = hits(spark, hit(1, 1, 0.9, ts=1), hit(2, 2, 0.1, ts=5))
    assert [r.id for r in fusion.ordered(h, recall_intent=True).orderBy("rank").collect()] == [2, 1]


def test_local_hit_wins(spark):
    local, hub = hits(spark, hit(1, 1, 0.2)), hits(spark, hit(1, 1, 0.9), hit(7, 7, 0.5))
    out = {r.id: (r.score, r.source) for r in fusion.merge_hub(local, hub).collect()}
    assert out == {1: (0.2, "local"), 7: (0.5, "fleet")}


def plain_merge(cards, slack=5000, take=3):
    merged = []
    for c in sorted(cards, key=lambda c: (-c["strength"], c["id"])):
        near = next((m for m in merged if (m["path"] and m["path"] == c["path"]) or (m["start_ms"] - slack <= c["end_ms"] and c["start_ms"] - slack <= m["end_ms"])), None)
        if near is None:
            merged.append(dict(c))
            continue
        near["vision"] |= c["vision"]
        near["heard"] |= c["heard"]
        near["strength"] = round(near["strength"] + c["strength"], 6)
        if near["transcript"] is None and c["transcript"] is not None:
            near.update({k: c[k] for k in ("id", "path", "start_ms", "end_ms", "transcript")})
    return sorted(merged, key=lambda m: (-m["strength"], m["id"]))[:take]


@pytest.mark.parametrize("seed", range(4))
def test_cards_merge_as_a_plain_loop_does(spark, seed):
    import random

    rng = random.Random(seed)
    cards = []
    for i in range(9):
        start = rng.randrange(0, 60_000)
        cards.append(
            {"id": i, "path": rng.choice(["", "a", "b"]), "start_ms": start, "end_ms": start + rng.choice([0, 4000]), "vision": i % 2 == 0, "heard": i % 2 == 1,
             "strength": round(rng.random(), 2) + i / 1000, "transcript": rng.choice([None, f"t{i}"])}
        )
    df = spark.createDataFrame([{"qid": 1, **c} for c in cards], "qid long, " + fusion.CARD.replace("bigint", "long"))
    found = [{k: r[k] for k in cards[0]} for r in fusion.merge_cards(df).orderBy("rank").collect()]
    want = plain_merge(cards)
    for w, f in zip(want, found, strict=True):
        assert {**f, "strength": round(f["strength"], 5)} == {**w, "strength": round(w["strength"], 5)}
