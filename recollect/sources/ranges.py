"""An index by a number, time above all: files by slots of it, so that a window or a page reads the files that it needs (REL4-REL7).

Rows are kept in folders by ``kind`` (if there is such a column) and slot, each slot a stretch of the number, and in order within.  Beside them
stands a small table with the number of rows of each slot.  A window names its slots by arithmetic.  The newest rows are looked for in the
newest slots: every slot that is listed has a row, so at most ``limit`` of them are looked at, and where a filter leaves too few rows, twice
as many slots each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slot on average.
ROWS = 100_000


class RangeIndex:
    """``by`` is the column of the order, ``kind`` the column whose values are kept apart, ``tie`` what orders rows of the same number."""

    def __init__(self, spark: SparkSession, path: str, by: str = "timestamp_ms", kind: str | None = "type", tie: str = "id"):
        self.spark, self.path, self.by, self.kind, self.tie = spark, path.rstrip("/"), by, kind, tie

    @property
    def keys(self) -> list[str]:
        return [self.kind, "slot"] if self.kind else ["slot"]

    @classmethod
    def build(cls, rows: DataFrame, path: str, by: str = "timestamp_ms", kind: str | None = "type", tie: str = "id", slot_rows: int = ROWS, slots: int = 1) -> RangeIndex:
        """Slots of ``slot_rows`` rows on average, or of fewer where that many are fewer than ``slots`` slots."""
        index = cls(rows.sparkSession, path, by, kind, tie)
        n, least, greatest = rows.agg(F.count(by), F.min(by), F.max(by)).first()
        slot_rows = min(slot_rows, max(1, -(-n // slots)))
        width = max(1, -(-(greatest - least + 1) * slot_rows // n)) if n else 1
        index.spark.createDataFrame([(int(width),)], "width long").coalesce(1).write.parquet(f"{index.path}/model")
        rows.withColumn("slot", F.lit(0).cast("long")).limit(0).write.parquet(f"{index.path}/schema")
        index.append(rows)
        return index

    @property
    def width(self) -> int:
        return self.spark.read.parquet(f"{self.path}/model").first().width

    def slot_of(self, value: int) -> int:
        return value // self.width

    def append(self, rows: DataFrame) -> None:
        """Rows without a number take no part.  A slot of very many rows is dealt to several files, each a stretch of it."""
        known = rows.filter(F.col(self.by).isNotNull()).withColumn("slot", F.floor(F.col(self.by) / self.width).cast("long"))
        order = [*self.keys, self.by, self.tie]
        dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt.write.mode("append").partitionBy(*self.keys).parquet(f"{self.path}/rows")
        known.groupBy(*self.keys).agg(F.count("*").alias("n")).write.mode("append").parquet(f"{self.path}/slots")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")

    def _of(self, df: DataFrame, kind: str | None, since: int | None, until: int | None) -> DataFrame:
        """By kind and slots."""
        if kind is not None and self.kind:
            df = df.filter(F.col(self.kind) == kind)
        if since is not None:
            df = df.filter(F.col("slot") >= self.slot_of(since))
        return df.filter(F.col("slot") <= self.slot_of(until)) if until is not None else df

    def window(self, kind: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
        """All rows of a window; both bounds belong to it."""
        found = self._of(self.rows(), kind, since, until)
        if since is not None:
            found = found.filter(F.col(self.by) >= since)
        return (found.filter(F.col(self.by) <= until) if until is not None else found).drop("slot")

    def first(self, limit: int, kind: str | None = None, since: int | None = None, until: int | None = None, where: Column | None = None, newest: bool = True) -> DataFrame:
        """The ``limit`` newest (or oldest) rows of a window, in that order, from as few slots as hold them."""
        order = [F.desc(self.by), self.tie] if newest else [self.by, self.tie]
        listed = self._of(self.spark.read.parquet(f"{self.path}/slots"), kind, since, until).groupBy("slot").agg(F.sum("n").alias("n"))
        found = self.window(kind, since, until) if where is None else self.window(kind, since, until).filter(where)
        bounds: dict[str, int | None] = {"since": since, "until": until}
        slots = -(-limit // 4) + 1
        while True:
            some = listed.orderBy(F.desc("slot") if newest else "slot").limit(slots).collect()
            if not some:
                return found.limit(0)
            # by the counts alone as few as hold the limit; slots at a window's edges and a filter may have less than they count
            edges, held, last = {self.slot_of(x) for x in (since, until) if x is not None}, 0, some[0]["slot"]
            for r in some:
                held, last = held + (r["n"] if r["slot"] not in edges else 0), r["slot"]
                if held >= limit and where is None:
                    break
            edge = {"since": last * self.width} if newest else {"until": (last + 1) * self.width - 1}
            inner = {k: v if edge.get(k) is None else edge[k] if v is None else (max if k == "since" else min)(v, edge[k]) for k, v in bounds.items()}
            part = self.window(kind, **inner)
            part = (part if where is None else part.filter(where)).orderBy(*order).limit(limit)
            if len(some) < slots or where is None and held >= limit or part.count() >= limit:
                return part
            slots *= 2

    def page(self, limit: int, after: int | None = None, kind: str | None = None) -> DataFrame:
        """A page in ascending order, from the row after ``after`` (REL7)."""
        return self.first(limit, kind, None if after is None else after + 1, newest=False)
