"""Numbers of rows in an order, without any task seeing a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming import run


def numbered(df: DataFrame, group: list[str], order: list[Column | str], name: str = "k") -> DataFrame:
    """``df`` with ``name``, the place (from 1) of each row in the order of its group.

    Rows are dealt out in ranges of group and order, numbered within each range, and each range starts after those before it; a group
    of any size is spread over ranges.  Spark takes the ranges' bounds from a sample, another one whenever it deals, so the rows
    are written once with their range and both readings have the same.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = run.shared_folder(spark)
    df.repartitionByRange(n, *group, *order).withColumn("__p", F.spark_partition_id()).write.parquet(place)
    parts = spark.read.parquet(place)
    counts = parts.groupBy(*group, "__p").agg(F.count("*").alias("__n"))
    # a row for each range and group that meet: few
    before = Window.partitionBy(*group, F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    own = parts.withColumn("__k", F.row_number().over(Window.partitionBy(*group, "__p").orderBy(*order)))
    same = F.col("__p") == F.col("__q")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return own.join(base, same).withColumn(name, (F.col("__k") + F.col("__b")).cast("long")).drop("__p", "__k", "__q", "__b", *[f"__{g}" for g in group])
