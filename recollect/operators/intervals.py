"""Joins on times (JON5-JON7).

Time is cut into slots, and a row meets those whose widened intervals touch the slot in which it starts, so these are equi-joins that shuffle by slot and
are checked exactly afterwards; no pair is met twice, as only the later start counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot(at: Column, width: int) -> Column:
    return F.floor(at / width).cast("long")


def slots(start: Column, end: Column, width: int) -> Column:
    return F.sequence(slot(start, width), slot(end, width))


def overlaps(a: DataFrame, b: DataFrame, slack_ms: int, width_ms: int | None = None) -> DataFrame:
    """Pairs of rows of ``a`` (``a_id``, ``a_start``, ``a_end``) and ``b`` (``b_...``) whose intervals, ``b`` widened by ``slack_ms`` on both sides, overlap."""
    width = width_ms or max(4 * slack_ms, 60_000)
    a_from, a_to, b_from, b_to = F.col("a_start"), F.col("a_end"), F.col("b_start") - slack_ms, F.col("b_end") + slack_ms
    every = lambda df, start, end: df.withColumn("slot", F.explode(slots(start, end, width)))
    at = lambda df, start: df.withColumn("slot", slot(start, width))
    meet = (a_from <= b_to) & (b_from <= a_to)
    # the later one's start is in one slot, and the other one covers it: no pair meets in a second slot, however long both are
    later_b = every(a, a_from, a_to).join(at(b, b_from), "slot").filter(meet & (b_from >= a_from))
    later_a = at(a, a_from).join(every(b, b_from, b_to), "slot").filter(meet & (b_from < a_from))
    return later_b.drop("slot").unionByName(later_a.drop("slot"))


def nearest(a: DataFrame, b: DataFrame, tolerance_ms: int) -> DataFrame:
    """For each row of ``a`` (``a_id``, ``a_ts``) the nearest of ``b`` (``b_id``, ``b_ts``) within the tolerance; the earlier one of equal, then the lesser id.

    A row looks into its slot and the two beside it, each as wide as the tolerance.
    """
    left = a.withColumn("slot", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: slot(F.col("a_ts"), tolerance_ms) + k)))
    right = b.withColumn("slot", slot(F.col("b_ts"), tolerance_ms))
    near = left.join(right, "slot").filter(F.abs(F.col("a_ts") - F.col("b_ts")) <= tolerance_ms)
    order = F.struct(F.abs(F.col("a_ts") - F.col("b_ts")), F.col("b_ts"), F.col("b_id"))
    found = near.groupBy("a_id").agg(F.min(order).alias("o"))
    return a.join(found, "a_id", "left").select("a_id", "a_ts", F.col("o.b_id").alias("b_id"), F.col("o.b_ts").alias("b_ts"))
