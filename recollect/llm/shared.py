"""What the operators of this subpackage share: the shared scratch folder, written tables, and Arrow columns.

Nothing here keeps state on one machine.  Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; they outlive a lost executor, and their sizes are known to the planner.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Rows in an Arrow batch: documents may be long, so a batch holds few of them.  Spark itself bounds its bytes (maxBytesPerBatch).
ARROW_ROWS = 128


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and the master is local, one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/recollect/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder: its lineage ends there and each later read is cheap."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: So many rows of ids and hashes are sent to all tasks at most; more are joined by a shuffle.
SENT_ROWS = 500_000


def sent(df: DataFrame) -> DataFrame:
    """A written table of ids and hashes, marked to be sent to all tasks if it is counted to be small."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Hold Arrow batches to ``rows`` rows, so that a Python worker has a few long texts at a time.

    The setting is the session's and is read when a plan runs, so it stays; a smaller value that the session has is left.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def arrow_column(
    df: DataFrame, batch: Callable[[], Callable[[list], pa.Array]], kind: DataType, *inputs: Column
) -> Column:
    """A column made from ``inputs`` by an Arrow function.

    ``batch()`` runs once in each task and returns a function from the lists of a batch's values to an Arrow array.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator[pa.Array]:
        make = batch()
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            yield make(*(c.to_pylist() for c in columns))

    if len(inputs) == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from run(batches)

        return F.arrow_udf(one, kind)(*inputs)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from run(batches)

    return F.arrow_udf(many, kind)(*inputs)


def with_fields(df: DataFrame, value: Column, kind: StructType) -> DataFrame:
    """``df`` with the fields of the struct column ``value``; a column of ``df`` with a field's name is replaced."""
    name = f"__fields_{uuid.uuid4().hex[:8]}"
    kept = [c for c in df.columns if c.lower() not in {f.name.lower() for f in kind}]
    return df.withColumn(name, value).select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(name)[f.name].alias(f.name) for f in kind]
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, so that none clashes with an operator's own; ``toDF`` gives the names back."""
    return df.toDF(*[place(k) for k in range(len(df.columns))])


def place(k: int) -> str:
    return f"__c{k}"


def place_of(df: DataFrame, name: str) -> str:
    """What ``by_place`` calls the column ``name``."""
    return place([c.lower() for c in df.columns].index(name.lower()))
