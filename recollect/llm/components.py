"""Connected components of a table of links, by alternating large and small stars.

Each step takes the least neighbour of each node (a partial aggregate) and joins it back, so that a node of very many links is
aggregated before it is shuffled and its links are split over tasks.  Steps end in written tables; the number of steps grows with
the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _joined(links: DataFrame) -> DataFrame:
    """``links`` (a, b) with ``m``, the least ``b`` of each ``a``, or ``a`` if that is less."""
    # grouped by one more (dependent) column, so that the join has a shuffle of its own on both sides and a node's links can be split
    least = links.groupBy("a", F.hash("a").alias("apart")).agg(F.min("b").alias("m"))
    return links.join(least.select("a", F.least("m", "a").alias("m")), "a")


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _joined(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = _joined(down).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s"))
    return stars.select("s.a", "s.b").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of all nodes of the links (a, b) but the roots themselves."""
    now = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == state or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, now = sign, written(small_star(large_star(now)), "links")
