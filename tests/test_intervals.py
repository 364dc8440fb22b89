"""Interval joins against all pairs, and how many pairs they look at."""

from pyspark.sql import functions as F

from recollect.operators import intervals


def spans(spark, side, n, longest):
    start = (F.xxhash64("id", F.lit(side)) % 1_000_000).alias(f"{side}_start")
    length = F.pmod(F.xxhash64(F.lit(side), "id"), F.lit(longest))
    return spark.range(n).select(F.col("id").alias(f"{side}_id"), start, (start + F.when(F.col("id") % 7 == 0, 0).otherwise(length)).alias(f"{side}_end")).localCheckpoint()


def test_overlaps_are_those_of_all_pairs(spark):
    a, b = spans(spark, "a", 300, 40_000), spans(spark, "b", 300, 900_000)
    for slack, width in ((0, 10_000), (700, 3000), (5000, 1_000_000)):
        plain = a.crossJoin(b).filter((F.col("a_start") <= F.col("b_end") + slack) & (F.col("b_start") - slack <= F.col("a_end")))
        pairs = lambda df: sorted(map(tuple, df.select("a_id", "b_id").collect()))
        assert pairs(intervals.overlaps(a, b, slack, width)) == pairs(plain) != []


def test_long_spans_meet_in_one_slot(spark):
    """Of spans that share hundreds of slots each pair is made once, not once for each slot."""
    a, b = ((spark.range(200).select(F.col("id").alias(f"{s}_id"), F.col("id").alias(f"{s}_start"), (F.col("id") + 1_000_000).alias(f"{s}_end"))) for s in "ab")
    out = intervals.overlaps(a, b, 0, 2000)
    assert out.count() == 40_000
    # one side of each join has a row of its own slot only
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join Inner") == 2 and plan.count("Generate explode") == 2
