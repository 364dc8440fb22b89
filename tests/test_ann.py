"""The trained index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recollect.operators import ann, search
from recollect.streaming import run


def clustered(n, size=32, groups=40, spread=0.25, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    m = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, size)) * np.linalg.norm(centres, axis=1).mean() / size**0.5
    return m.astype(np.float32)


@pytest.fixture(scope="module")
def made(spark):
    m = clustered(3000)
    p = spark.createDataFrame([(k, "frame" if k % 2 else "ocr", 1000 + k, v.tolist()) for k, v in enumerate(m)], "id long, type string, timestamp_ms long, clip array<float>").repartition(3)
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("clip").cast("array<double>").alias("q"))
    return p, q, ann.Index.build(p, run.shared_folder(spark), lists=48)


def pairs(df):
    return {(r["qid"], r["id"]) for r in df.collect()}


def test_clusters_are_found_in_few_lists(made):
    p, q, index = made
    truth = search.knn(p, q)
    sizes = {r["list"]: r["n"] for r in index.points().groupBy("list").agg(F.count("*").alias("n")).collect()}
    read = np.mean([sum(sizes.get(int(c), 0) for c in own) for _, m in index._blocks(q) for own in index.quantiser().probes(m, 5)]) / 3000
    assert read <= 0.15
    for found in (index.search_lists(q, 5, 5), index.search(q, 5, 5, 64)):
        assert len(pairs(truth) & pairs(found)) >= 0.9 * truth.count()
        assert [r["n"] for r in found.groupBy("qid").agg(F.count("*").alias("n")).select("n").distinct().collect()] == [5]


def test_plan_reads_named_lists_and_joins_by_list(made):
    _, q, index = made
    plan = index.search_lists(q.limit(1), 5, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    filters = [x for x in plan.split("\n") if "PartitionFilters: [" in x and "list#" in x.split("PartitionFilters: [")[1].split("]")[0]]
    assert filters
    files = [r[0] for r in index.points().filter(F.col("list").isin([1, 2, 3])).select(F.input_file_name()).distinct().collect()]
    assert files and all(any(f"/list={c}/" in f for c in (1, 2, 3)) for f in files) and len(files) < len(index.points().inputFiles()) / 5


def test_bytes_and_rescoring_find_the_best(spark):
    folder = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("clip"))
    q = e.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("clip").alias("q"))
    index = ann.Index.build(e, run.shared_folder(spark))
    truth = search.knn(e, q)
    found = index.search(q, 5, ann.LISTS, 100)  # a twentieth of the points in full
    assert len(pairs(truth) & pairs(found)) >= 0.9 * truth.count()
    scores = {(r["qid"], r["id"]): r["score"] for r in truth.collect()}
    assert all(scores.get((r["qid"], r["id"]), r["score"]) == r["score"] for r in found.collect())


def test_tables_give_the_products_of_decoded_vectors():
    m = ann.unit(clustered(600, 16).astype(np.float64))
    centres = ann.directions(m, 10)
    own = ann.nearest(m, centres)
    rest = m - centres[own]
    model = ann.Quantiser(centres, [ann.book_of(rest[:, x : x + 4], 64, 4) for x in range(0, 16, 4)])
    codes, q = model.codes(m, own), m[:7]
    decoded = centres[own] + np.concatenate([b[codes[:, j]] for j, b in enumerate(model.books)], 1)
    tables = model.tables(q)
    approx = q @ centres.T[:, own] + sum(tables[:, j][:, codes[:, j]] for j in range(4))
    assert np.allclose(approx, q @ decoded.T)
    assert ((rest - (decoded - centres[own])) ** 2).sum() < 0.5 * (rest**2).sum()


def test_append_filter_and_empty(made, spark):
    p, q, _ = made
    index = ann.Index.build(p.filter("id < 1000"), run.shared_folder(spark), lists=20)
    index.append(p.filter("id >= 1000"))
    assert index.points().count() == 3000
    everything = len(index.quantiser().centres)
    own = F.col("type") == "ocr"
    assert pairs(index.search_lists(q, 5, everything, own)) == pairs(search.knn(p.filter(own), q))
    empty = ann.Index.build(p.limit(0), run.shared_folder(spark))
    assert empty.search_lists(q.limit(0)).count() == 0 and empty.points().count() == 0
    assert index.search(q.limit(0)).count() == 0


def test_blocks_of_queries_give_the_same(made, monkeypatch):
    _, q, index = made
    once = sorted(map(tuple, index.search(q, 3, 4, 20).collect()))
    monkeypatch.setattr(ann, "BLOCK", 17)
    assert sorted(map(tuple, index.search(q, 3, 4, 20).collect())) == once and len(once) == 180
