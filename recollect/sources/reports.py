"""Reports and files of the benchmark (SNK11, REL23, EVL3-EVL5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stop a run after two chunks below this rate (points a second).
LEAST_RATE, CHUNKS = 150.0, 2


def write_csv(df: DataFrame, path: str) -> None:
    """Long form with a head: ``op,run,ms``."""
    df.select("op", "run", "ms").write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: list[dict]) -> str:
    """A table of one row for each scale."""
    if not rows:
        return ""
    head = list(rows[0])
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(r[h]) for h in head) + " |" for r in rows)])


def disk_usage(spark: SparkSession, folder: str, namespace: str) -> DataFrame:
    """Bytes of the files whose path has the namespace as a whole word (REL23); contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.filter(F.col("path").rlike(rf"(?<![A-Za-z0-9])\Q{namespace}\E(?![A-Za-z0-9])")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def clustered(n: int, size: int, seed: int = 0, spread: float = 0.05) -> np.ndarray:
    """Unit vectors around a centre for each hundred, six at least (EVL3)."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(6, n // 100), size))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, size))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def workload(ids: DataFrame, size: int, centres: int = 100, spread: float = 0.05) -> DataFrame:
    """A unit vector ``v`` for each ``id``, near one of the ``centre`` vectors (EVL3): made by the tasks from the id alone, so the same each time."""
    k = F.sequence(F.lit(1), F.lit(size))
    one = F.col("id")
    own = F.transform(k, lambda i: F.cos((F.pmod(one, F.lit(centres)) + 1) * (0.7 + (i * i) % 13)))
    moved = F.zip_with("centre", k, lambda x, i: x + spread * F.sin((one + 1) * (0.3 + i % 7)))
    # arrays are made once, and then used by name
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    unit = once(moved, lambda m: once(F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(m, lambda x: x / n)))
    return ids.select("id", once(own, lambda c: F.struct(c.alias("centre"))).alias("c")).select("id", F.col("c.centre").alias("centre")).select("id", unit.alias("v"), "centre")


def timings(df: DataFrame) -> DataFrame:
    """Upper median, p90, least, most and mean of the runs (``ms``) of each ``op`` (EVL4): equal times are counted first, then ranked by their counts."""
    counts = df.groupBy("op", "ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("op").orderBy("ms")
    upto = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy("op")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("ms")))
    middle, late = F.floor(F.col("all") / 2), F.floor(F.col("all") * 9 / 10)
    mean = F.round(F.sum(F.col("ms") * F.col("n")) / F.first("all"), 6)
    return upto.groupBy("op").agg(at(middle).alias("median"), at(late).alias("p90"), F.min("ms").alias("least"), F.max("ms").alias("most"), mean.alias("mean"))


def given_up(rates: list[float], least: float = LEAST_RATE, chunks: int = CHUNKS) -> bool:
    """Whether so many chunks in a row were too slow (EVL5)."""
    slow = 0
    for r in rates:
        slow = slow + 1 if r < least else 0
        if slow >= chunks:
            return True
    return False


def slow_runs(df: DataFrame, least: float = LEAST_RATE, chunks: int = CHUNKS) -> DataFrame:
    """``key`` and ``at``: where each run of chunks (``key``, ``chunk``, ``rate``) is given up, if it is: the last of so many slow ones in a row (EVL5)."""
    w = Window.partitionBy("key").orderBy("chunk").rowsBetween(-(chunks - 1), 0)
    slow = df.withColumn("slow", F.sum(F.when(F.col("rate") < least, 1).otherwise(0)).over(w))
    return slow.filter(F.col("slow") == chunks).groupBy("key").agg(F.min("chunk").alias("at"))


def timing(ms: list[float]) -> dict[str, float]:
    """Upper median, p90, least, most and mean of runs (EVL4, AGG5, AGG6)."""
    s = sorted(ms)
    return {"median": s[len(s) // 2], "p90": s[len(s) * 9 // 10], "min": s[0], "max": s[-1], "mean": sum(s) / len(s)}
