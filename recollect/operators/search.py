"""Vector search (VEC).  Scores are rounded to six digits before they are compared, and equal scores are ordered by id."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import pairs

DIGITS = pairs.DIGITS


def against(points: DataFrame, queries: DataFrame) -> DataFrame:
    """All points with each query: block after block of queries, each sent to the points."""
    return reduce(DataFrame.unionByName, [points.crossJoin(F.broadcast(b)) for b in pairs.blocks(queries)])


def top(scored_points: DataFrame, k: int, order: Column | None = None) -> DataFrame:
    """The ``k`` best of each query with their ``rank``; each task keeps its own best before anything is shuffled."""
    w = Window.partitionBy("qid").orderBy(order if order is not None else F.desc("score"), "id")
    return scored_points.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(points: DataFrame, queries: DataFrame, k: int = 5, vector: str = "clip") -> DataFrame:
    """Exact search by cosine (VEC1-VEC6): filter the points first, and ``k`` come back whenever so many are left."""
    return top(pairs.nearest(points, queries, k, vector), k)


def overfetch(points: DataFrame, queries: DataFrame, keep: Column, k: int = 5) -> DataFrame:
    """Candidates first and the filter after, so fewer than ``k`` may come back (VEC7)."""
    found = knn(points, queries, max(200, 8 * k, 64)).filter(keep)
    return top(found.drop("rank"), k)


def binary(points: DataFrame, queries: DataFrame, k: int = 5, oversample: int = 32) -> DataFrame:
    """Search by sign codes, then exact scores of ``oversample * k`` candidates (VEC8, VEC9)."""
    coded = points.withColumn("code", F.coalesce(V.sign_code(F.col("clip")), F.lit(0).cast("long")))
    asked = queries.withColumn("code", F.coalesce(V.sign_code(F.col("q")), F.lit(0).cast("long")))
    near = top(pairs.nearest(coded, asked, k * oversample, code="code"), k * oversample, F.asc("apart")).drop("rank", "apart")
    return top(near, k)


def cells(points: DataFrame, bits: int = 4) -> DataFrame:
    """``points`` with ``cell``, the first bits of their sign code: a coarse partition to search in parts (VEC11, VEC12)."""
    return points.withColumn("cell", V.sign_code(F.slice("clip", 1, bits)))


def cell_search(points: DataFrame, queries: DataFrame, k: int = 5, bits: int = 4, differing: int = 2) -> DataFrame:
    """Approximate search: only cells that differ from the query's in few bits; recall grows with ``differing`` (VEC11, VEC12).

    Points meet the queries of the cells around their own only.  ``ann.Index`` has lists that are fitted to the points instead.
    """
    asked = queries.withColumn("cell", V.sign_code(F.slice("q", 1, bits)))

    def looks(block: pairs.Asked):
        own = pairs.ids_of(block.table["cell"])
        return lambda cell: np.flatnonzero(np.bitwise_count(own ^ cell) <= differing)

    return top(pairs.nearest(cells(points, bits).filter("cell IS NOT NULL"), asked.filter("cell IS NOT NULL"), k, group="cell", looks=looks), k)


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Mean share of each query's true ids that were found (EVL1)."""
    t = truth.groupBy("qid").agg(F.collect_set("id").alias("t"))
    g = found.groupBy("qid").agg(F.collect_set("id").alias("g"))
    share = F.size(F.array_intersect("t", F.coalesce("g", F.array().cast("array<bigint>")))) / F.size("t")
    return t.join(g, "qid", "left").agg(F.round(F.avg(share), DIGITS).alias("recall"), F.count("*").alias("queries"))
