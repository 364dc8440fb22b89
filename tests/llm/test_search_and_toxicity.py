"""Operators 11, 12 and 13 against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from recollect.llm import hard_negatives as H
from recollect.llm import quality
from recollect.llm import ranked_search as R
from recollect.llm import toxicity as X

FOLDER = "/root/testdata/sf0.01"


# --- 11


def plain_segments(scores):
    """The best segment (shortest among equals), then those left and right of it, again and again."""
    found = []

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9 or abs(total - best[0]) <= 1e-9 and j - i < best[2] - best[1]):
                    best = (total, i, j)
        if best:
            split(a, best[1])
            found.append((best[1], best[2], best[0]))
            split(best[2] + 1, b)

    split(0, len(scores))
    return found


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_all_maximal_ones(seed):
    rng = random.Random(seed)
    n, rest = rng.randrange(1, 40), -rng.choice([0.37, 1.13, 2.59])
    places = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
    values = [rng.choice([-1, 1, 1]) * rng.uniform(0.1, 4) for _ in places]
    scores = [rest] * n
    for p, v in zip(places, values):
        scores[p] = v
    found = X.segments(places, values, rest)
    want = plain_segments(scores)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in found], [x[2] for x in want])


def test_segments_take_linear_time():
    n = 200_000
    found = X.segments(list(range(0, 3 * n, 3)), [1.0 if k % 2 else 0.4 for k in range(n)], -0.3)
    assert found and len(found) <= n
    assert len(X.segments(list(range(0, 10 * n, 10)), [1.0 + (k % 7) / 10 for k in range(n)], -0.3)) == n


def test_scale_solves_its_equation():
    scores, shares = np.array([2.0, 1.0, -0.4]), np.array([0.02, 0.05, 0.93])
    assert abs(np.dot(shares, np.exp(X.root_scale(scores, shares) * scores)) - 1) < 1e-6


def test_toxicity_held_out(spark):
    out = entry.queries()["op11_toxicity"](spark, FOLDER)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "n_passages"] and "predicted" in out.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [r for r in rows.values() if r["held_out"] and r["doc_id"] in labels]
    bad, good = ([r["score"] for r in held if labels[r["doc_id"]] == y] for y in (1, 0))
    auc = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    assert auc > 0.75
    assert np.mean([labels[r["doc_id"]] for r in held if r["predicted"]]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


INSULTS = ["wumpus", "grobble"]


def made(n, seed=3):
    """Texts of common words; every fourth has an insult or two."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        some = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        if k % 4 == 0:
            for _ in range(2):
                some.insert(rng.randrange(len(some)), rng.choice(INSULTS).upper() + "!")
        rows.append((k, " ".join(some), int(k % 4 == 0)))
    return rows


def test_copies_teach_once_and_passages_are_found(spark):
    rows = made(200)
    copied = "odd rare words stand here " + " ".join(f"x{k}" for k in range(30))
    rows += [(1000 + k, copied, 1) for k in range(60)]  # one mislabelled text with many copies
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = X.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert set(model.scores) == set(INSULTS)
    got = {r["doc_id"]: r for r in X.with_score(table.drop("toxic"), model).collect()}
    for k, text, y in rows:
        r = got[k]
        assert (r["score"] >= X.TOXIC) == (y == 1 and k < 1000)
        for p in r["passages"]:
            inside = text[p["start"] : p["end"]].lower()
            assert any(w in inside for w in INSULTS) and p["expected"] < X.SIGNIFICANT


def test_toxicity_of_odd_rows(spark, odd, nothing, clashing):
    rows = made(200)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    out = X.with_score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] < X.TOXIC and r["passages"] == [] for r in out)
    assert X.with_score(nothing, model).count() == 0
    assert set(X.with_score(clashing, model).columns) == {*clashing.columns, "passages"}
    assert model.scored("İ" * 40 + " wumpus, wumpus")[1][0]["start"] == 41
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, score in ((none, 0.0), (spark.createDataFrame([(0, 1), (4, 1)], "doc_id long, toxic int"), 1.0), (spark.createDataFrame([(1, 0), (0, None), (4, 0), (4, 1)], "doc_id long, toxic int"), 0.0)):
        m = X.fit(table.select("doc_id", "text"), labels)
        assert m.constant == score and m.scored("anything")[0] == score
    assert X.fit(nothing, none).constant == 0.0


# --- 12


def plain_search(docs, items, k=50):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    held = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(held, sizes):
            m = 50 + (50 * n * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(term.findall(lower(text))) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def compared(spark, docs, items, **limits):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return in_order(map(tuple, R.search(d, q, **limits).collect())), in_order(plain_search(docs, items, limits.get("k", 50)))


def test_search_against_plain_loops(spark):
    rng = random.Random(8)
    words = [f"t{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(400)]
    docs += [(k, docs[7][1]) for k in range(7, 30)] + [(None, docs[7][1]), (None, None), (3, ""), (5, "t1 " * 20_000)]
    items = [(k % 6, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for k in range(12)] + [(None, "t1 T1 t2"), (77, None), (78, "unheard")]
    for limits in ({}, {"k": 3}, {"k": 5, "block": 4}):
        found, want = compared(spark, docs, items, **limits)
        assert found == want and found


def test_treaps_prune_and_small_blocks_agree(spark):
    rng = np.random.default_rng(1)
    n, terms = 5000, 6
    held = rng.random((n, terms)) < 0.3
    counts = np.where(held, rng.geometric(0.3, (n, terms)), 0)
    place, term = np.nonzero(counts)
    lengths, sizes = held.sum(1), counts.sum(1) + 5
    weights = np.array([900, 1500, 2500, 4000, 300, 0], np.int64)
    shard = R.Shard(sizes, lengths, term.astype(np.int64), counts[place, term].astype(np.int64), weights, n, int(sizes.sum()))
    m = 50 + 50 * sizes * n // sizes.sum()
    score = (weights * (10**9 * counts // np.maximum(1000 * counts + 20 * m[:, None], 1))).sum(1)
    want = np.sort(score)[::-1][:10]
    for states in (1, 7, 1024):
        places, scores, scored = shard.best(np.arange(terms), 10, 0, states)
        assert (np.sort(scores)[::-1][:10] == want).all() and (score[places] == scores).all() and len(set(places.tolist())) == len(places)
        if states < 10:
            assert scored < n / 4  # the rest was pruned unseen
    for v in np.flatnonzero(shard.left >= 0):  # heap order of impacts, search order of places
        assert shard.impact[shard.left[v]] <= shard.impact[v] and shard.place[shard.left[v]] < shard.place[v]
    for v in np.flatnonzero(shard.right >= 0):
        assert shard.impact[shard.right[v]] <= shard.impact[v] and shard.place[shard.right[v]] > shard.place[v]


def test_shards_of_few_rows_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randrange(1, 9)))) for k in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    wanted = {b"a": 0, b"b": 1, b"c": 2}
    index = R.postings(table, wanted, "text", "doc_id")
    weights = np.array([700, 800, 900], np.int64)
    every = [sorted(map(tuple, R.walked(index, [np.arange(3)], weights, 300, 1500, 5).collect()))]
    assert len(every[0]) == 5


def test_search_of_empty_tables(spark, nothing, clashing):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert R.search(nothing, items).count() == 0
    assert R.search(clashing, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    found = R.search(clashing, items.selectExpr("*", "'x' AS doc_id", "1 AS rank"))
    assert found.count() > 0


# --- 13


def plain_negatives(rows, chosen, window=80):
    good = [(k, i, y, np.floor(256.0 * np.array(v, np.float64))) for k, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s, i, k: (-s, i is None, i or 0, k)
    out = []
    for k, i, y, v in good:
        if i is None or not chosen(i):
            continue
        scored = [(int(v @ w), j, l, z) for l, j, z, w in good if l != k]
        for s, j, l, _ in sorted((x for x in scored if x[3] == y), key=lambda x: key(x[0], x[1], x[2]))[:5]:
            bad = sorted((x for x in scored if x[3] != y and window * s <= 100 * x[0] <= 100 * s), key=lambda x: key(x[0], x[1], x[2]))[:5]
            out += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(bad)]
    return out


def vectors(n, size, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, size))
    rows = []
    for k in range(n):
        v = centres[k % 8] + spread * rng.normal(size=size)
        v *= rng.uniform(0.5, 1.5) / np.linalg.norm(v)
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("n", "size", "spread", "anchors", "part"), [(400, 8, 0.1, 16, 50), (300, 16, 5.0, 512, 8192)])
def test_negatives_against_plain_loops(spark, monkeypatch, n, size, spread, anchors, part):
    from pyspark.sql import functions as F

    monkeypatch.setattr(H, "ANCHORS", anchors)
    monkeypatch.setattr(H, "ROWS", part)
    rows = vectors(n, size, 4, spread)
    rows += [(1000 + k, rows[10][1], k % 3) for k in range(60)]  # a vector of many rows
    rows += [(20, rows[20][1], rows[20][2]), (2000, None, 1), (2001, rows[1][1], None), (2002, [float("nan")] * size, 1), (2003, [None] * size, 1), (2004, [float("inf")] * size, 1), (2005, [0.0] * size, 1), (None, rows[3][1], 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = H.mine(table, F.col("vec_id") % 5 == 0)
    got, want = (in_order([(r[0], r[2], r[4], r[5]) for r in x]) for x in (map(tuple, found.collect()), plain_negatives(rows, lambda i: i % 5 == 0)))
    assert got == want and len(got) > 500
    # ids too, but for rows that tie in score and id
    ids = lambda x: Counter((r[0], r[1], r[2], r[3]) for r in x)
    assert ids(map(tuple, found.collect())) == ids(plain_negatives(rows, lambda i: i % 5 == 0))


def test_bounds_keep_rows_from_groups(spark):
    from pyspark.sql import functions as F

    rows = vectors(4000, 8, 9, 0.05)
    table = H.usable(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, "vec_id", "embedding", "label")
    sphere = H.fitted(table, 400)
    anchors = H.placed(table.filter("anchor"), sphere)
    blocks = {r["cell"]: 1 for r in anchors.select("cell").distinct().collect()}
    own = H.merged(H.met(anchors, H.sent_to(table, sphere, blocks, None, None), blocks, 2, sphere, lambda left, k, s, same, others: [(0, H.top(s, same & others, 5))]), 5)
    low, high = H.bounds(anchors, own.groupBy("anchor").agg(F.min("score").alias("least")), sphere)
    sent = H.sent_to(table, sphere, blocks, low, high).count()
    assert len(blocks) >= 3 and sent < 0.6 * len(blocks) * table.count(), (sent, len(blocks))


def test_large_components_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [-(2.0**90), 0.0]])
    assert H.products(a, b).tolist() == [[2**60 + 3, -(2**63)]]


def test_negatives_of_empty_and_odd_tables(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty, F.col("vec_id") % 5 == 0).count() == 0
    ragged = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [], 2), (None, [0.95], 2)], SCHEMA).selectExpr("*", "1 AS row", "'x' AS cell", "2 AS anchor")
    got = {tuple(r) for r in H.mine(ragged, F.col("vec_id") == 0).collect()}
    assert got == {(0, 1, 1, None, 65536, 243 * 256), (0, 1, 2, 2, 65536, 230 * 256)}


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_hard_negatives"])
def test_sql_gives_the_same(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    out = entry.queries()[name](spark, FOLDER)
    want = db.sql(entry.oracle_sql()[name])
    assert in_order(map(tuple, out.select(*want.columns).collect())) == in_order(want.fetchall()) != []
