"""Search by matrix products against the column expressions, pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.operators import ann, pairs, search
from recollect.streaming import run


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near ties, zeros, other lengths, nulls, components that aren't numbers or are very small."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 8))
    m[100:160] = m[7]
    m[160:200] = m[7] + 1e-7 * rng.normal(size=(40, 8))
    rows = [v.tolist() for v in m]
    rows[3], rows[50], rows[200], rows[201], rows[202] = [0.0] * 8, rows[50][:5], None, [None] * 8, []
    rows[203], rows[204], rows[205] = [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1e-200] * 8
    p = spark.createDataFrame([(k, f"n{k}", v) for k, v in enumerate(rows)], "id long, name string, clip array<double>").repartition(3)
    q = p.filter("id % 50 = 0 OR id IN (3, 7, 101)").select(F.col("id").alias("qid"), F.col("clip").alias("q"))
    return p, q


def every(p, q):
    return p.crossJoin(q).withColumn("score", F.round(V.cosine(F.col("clip"), F.col("q")), 6))


def rows(df, *columns):
    return sorted((tuple(map(repr, r)) for r in df.select(*columns).collect()))


@pytest.mark.parametrize("k", [1, 5, 90, 1000])
def test_best_are_those_of_the_expressions(odd, k, monkeypatch):
    p, q = odd
    plain = search.top(every(p, q), k)
    columns = ("qid", "id", "name", "score", "rank")
    assert rows(search.knn(p, q, k), *columns) == rows(plain, *columns)
    monkeypatch.setattr(pairs, "SENT_QUERIES", 4)
    assert rows(search.knn(p, q, k), *columns) == rows(plain, *columns)


def test_texts_as_ids(odd):
    p, q = odd
    named = p.select(F.concat(F.lit("x"), F.col("name")).alias("id"), "clip")
    assert rows(search.knn(named, q, 9), "qid", "id", "rank") == rows(search.top(every(named, q), 9), "qid", "id", "rank")


def test_all_pairs_are_those_of_the_expressions(odd):
    p, q = odd
    apart = F.zip_with("clip", "q", lambda x, y: x - y)
    l2 = F.round(V.similarity_from_squared_l2(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)), 5)
    plain = every(p, q).select("qid", "id", F.col("score").alias("by_cosine"), F.when((F.size("clip") == F.size("q")) & (F.size("q") > 0), l2).alias("by_l2"))
    usual = "id NOT BETWEEN 200 AND 205 AND qid <> 200"
    assert rows(pairs.compared(p, q).filter(usual), "qid", "id", "by_cosine", "by_l2") == rows(plain.filter(usual), "qid", "id", "by_cosine", "by_l2")
    assert rows(pairs.compared(p, q), "qid", "id", "by_cosine") == rows(plain, "qid", "id", "by_cosine")


def test_all_pairs_come_in_runs_of_equal_cosines(spark, tmp_path):
    """Pairs in order of points and queries took nearly 16 bytes each, more than a disk holds for a large table."""
    m = np.random.default_rng(7).normal(size=(16_000, 64))
    p = spark.createDataFrame([(k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(m)], "id long, clip array<double>")
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("clip").alias("q"))
    out = str(tmp_path / "all")
    pairs.compared(p, q).write.parquet(out)
    assert spark.read.parquet(out).agg(F.count("*"), F.countDistinct("qid", "id")).first()[:] == (len(m) ** 2 // 50,) * 2
    assert sum(f.stat().st_size for f in (tmp_path / "all").glob("*.parquet")) < 10 * len(m) ** 2 // 50


def test_numbers_in_order_with_their_places():
    x = np.array([0.5, -0.25, np.nan, 0.5, np.inf, 0.0, -0.25, -np.inf])
    at, values = pairs.in_order(x)
    assert at.tolist() == [1, 6, 5, 0, 3, 2, 4, 7] and list(map(repr, values.tolist())) == list(map(repr, x[at].tolist()))
    at, values = pairs.in_order(x[[0, 1, 3, 5]])
    assert at.tolist() == [1, 3, 0, 2] and values.tolist() == [-0.25, 0.0, 0.5, 0.5]


def test_halves_are_rounded_by_their_digits():
    x = np.array([0.1234565, -0.1234565, 0.0000005, -0.0000005, 1.0, np.nan, 0.4999995, 2.5e-6])
    assert list(map(repr, pairs.rounded(x).tolist())) == ["0.123457", "-0.123457", "1e-06", "-1e-06", "1.0", "nan", "0.5", "3e-06"]


def test_no_pair_is_a_row_of_the_plan(odd):
    """A search that makes a row of each pair doesn't end on a large table."""
    p, q = odd
    for df in (search.knn(p, q, 5), search.binary(p, q), search.overfetch(p, q, F.col("id") > 3), search.cell_search(p, q), pairs.compared(p, q)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and " Join " not in plan


def test_a_task_gives_no_more_than_k_of_copies(spark):
    p = spark.range(5000).select("id", F.array(*[F.lit(1.0)] * 4).alias("clip"))
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("clip").alias("q"))
    tasks = pairs.TASKS * spark.sparkContext.defaultParallelism
    assert pairs.nearest(p, q, 3).count() <= 100 * 3 * tasks
    assert {r["id"] for r in search.knn(p, q, 3).collect()} == {0, 1, 2}


def test_the_driver_makes_no_row_for_each_query_and_list(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(500, 8)))], "id long, clip array<double>")
    q = p.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("clip").alias("q"))
    index = ann.Index.build(p, run.shared_folder(spark), lists=20)
    made, plain = [], spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (made.append(len(data) if hasattr(data, "__len__") else 0), plain(data, *a, **k))[1])
    found = index.search_lists(q, 5, 20)
    assert sum(made) == 0 and found.count() == 50
