"""Numbers in an order over more rows than the sample that ranges are cut by."""

from pyspark.sql import functions as F

from recollect.operators import sync
from recollect.operators.ranking import numbered


def test_numbers_of_many_rows_are_the_places(spark):
    many = spark.range(0, 1_500_000, 1, 4).select((F.col("id") * 7919 % 1_500_000).alias("id"), F.concat(F.lit("l"), "id").alias("label"))
    got = numbered(many, [], ["id"])
    got = got.filter(F.col("label").startswith("l"))  # read, so that the two readings differ in their columns
    assert got.agg(F.count("*"), F.count_if(F.col("k") != F.col("id") + 1)).first()[:] == (1_500_000, 0)


def test_seed_of_many_frames_runs_on(spark):
    frames = spark.range(0, 1_500_000, 1, 4).select((F.col("id") * 7919 % 1_500_000).alias("id"), F.lit("frame").alias("type"), F.lit("").alias("label"), (F.col("id") * 7919 % 1_500_000).alias("moment_id"), F.array(F.lit(1.0)).alias("clip"))
    got = sync.seed(frames)
    got = got.filter(F.col("label") == F.concat(F.lit("FLEET: "), "id"))
    assert got.agg(F.count("*"), F.count_distinct("seq"), F.count_if(F.col("seq") != F.col("id") + 1)).first()[:] == (1_500_000, 1_500_000, 0)
