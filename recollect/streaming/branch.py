"""A side branch beside the path of frames (STR7): frames commit, and what is read from them may fail without touching them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .run import shared_folder

LINE = "moment_id long, line int, text string, l double, t double, r double, b double, error string"


def with_lines(frames: DataFrame, recognise: Callable[[pd.Series], list[tuple]], key: str = "moment_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A stream of frames through two sinks, for all input there is now: (frames, lines read from them, what failed).

    Each batch's frames are committed first, and an error there stops the stream, which takes the batch up again.  Only then the branch reads the
    committed frames, so it never makes them anew.  ``recognise`` gives (line, text, l, t, r, b) of a frame; a frame that it fails
    on is counted with its error, and if the branch fails as a whole (a worker is lost, its sink is full) its batch is counted; the stream
    goes on in either case.  Both sinks are named by the batch, so a batch that is run again replaces what it wrote.
    """
    spark, place = frames.sparkSession, shared_folder(frames.sparkSession)
    names = [f.name for f in StructType.fromDDL(LINE)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for _, frame in pdf.iterrows():
                try:
                    rows += [(int(frame[key]), *x, None) for x in recognise(frame)]
                except Exception as e:  # whatever the reader raises: the frame is stored already
                    rows.append((int(frame[key]), None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=names)

    def both(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/frames/batch={number}")
        stored = spark.read.schema(frames.schema).parquet(f"{place}/frames/batch={number}")
        try:
            stored.mapInPandas(read, LINE).write.mode("overwrite").parquet(f"{place}/lines/batch={number}")
        except Exception as e:  # the branch as a whole
            lost = spark.createDataFrame([(number, f"{type(e).__name__}: {e}"[:200])], "batch long, error string")
            lost.write.mode("overwrite").parquet(f"{place}/lost/number={number}")

    frames.writeStream.foreachBatch(both).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    empty = {"frames": frames.schema, "lines": StructType.fromDDL(LINE), "lost": StructType.fromDDL("batch long, error string")}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{place}/{name}/none")
    table = lambda name: spark.read.schema(empty[name]).parquet(f"{place}/{name}/*")
    lines = table("lines")
    failed = lines.filter("error IS NOT NULL").select(F.col(key), "error").unionByName(table("lost").select(F.lit(None).cast("long").alias(key), "error"))
    return table("frames"), lines.filter("error IS NULL").drop("error"), failed
