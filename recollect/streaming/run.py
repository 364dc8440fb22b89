"""Running a stream to the end of what is there, and reading what it wrote."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without one, a temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/recollect/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def available_now(stream: DataFrame, mode: str = "append", then: Callable[[], None] | None = None) -> DataFrame:
    """What ``stream`` gives for all input there is now, as a table; each batch is written once, under its number.

    ``then`` may add input; the stream takes it up where it has ended.
    """
    spark = stream.sparkSession
    place = shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    def run() -> None:
        writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    if then is not None:
        then()
        run()
    # a stream that had no batch leaves no folder: the empty one stands for it
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{place}/out/batch=-1")
    return spark.read.schema(stream.schema).parquet(f"{place}/out/*").select(*stream.columns)
