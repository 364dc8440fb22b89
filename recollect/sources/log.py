"""An append-only log of a table: a base, deltas, and numbered manifests (STR11, SNK4, SNK6, REL12).

A commit writes its rows to a folder of their own and then creates the next manifest, which names the base and all deltas.  Creating a file
that is there already fails, so of two writers one commits and the other looks at the new state and tries again; a reader takes the newest
manifest and reads whole versions, also while others write.  What a commit writes is in proportion to its rows, never to the table.

Three kinds of deltas: ``put`` (whole rows that take the place of older ones of their id), ``flag`` (ids whose flag column becomes true), and
``gone`` (ids that are no more).  Many deltas are merged into one, and when that has grown to a part of the base, base and delta
become a new base; neither changes a row that is read.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PUT, FLAG, GONE = "put", "flag", "gone"
#: Deltas that are merged, and the part of the base's bytes from which on the merged delta goes into a new base.
MERGED, PART = 32, 0.5
ATTEMPTS = 100

# creating a file only if there is none is one step on a shared file system, but two on that of a machine
_local = threading.Lock()


class Conflict(RuntimeError):
    """Another writer has committed in between."""


class Log:
    """``columns`` is the schema of the table; ``key`` names its id, ``flag`` its flag column, ``parts`` what the base is partitioned by."""

    def __init__(self, spark: SparkSession, root: str, columns: StructType, key: str = "id", flag: str = "synced", parts: tuple[str, ...] = ()):
        self.spark, self.root, self.columns, self.key, self.flag, self.parts = spark, root.rstrip("/"), columns, key, flag, parts
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests

    def _name(self, number: int) -> str:
        return f"{self.root}/log/{number:012d}.json"

    def numbers(self) -> list[int]:
        at = self.path(f"{self.root}/log")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, number: int | None = None) -> dict:
        """What the newest version, or an older one, is made of."""
        if number is None:
            number = max(self.numbers(), default=-1)
            if number < 0:
                return {"number": -1, "base": None, "deltas": []}
        lines = self.spark.read.text(self._name(number)).collect()
        return json.loads("".join(r.value for r in lines))

    def _create(self, made: dict) -> None:
        """Write the next manifest; ``Conflict`` if there is one of its number."""
        aside, at = self.path(f"{self.root}/log/.{uuid.uuid4().hex}"), self.path(self._name(made["number"]))
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        with _local:
            # a rename onto a file that is there fails, so a manifest is whole from the moment that it has its name
            ok = not self.fs.exists(at) and self.fs.rename(aside, at)
        if not ok:
            self.fs.delete(aside, False)
            raise Conflict(f"version {made['number']} is there already")

    def commit(self, change: Callable[[dict], dict | None]) -> int:
        """``change`` makes a new manifest of the newest one, again if another writer was faster; the version's number."""
        for _ in range(ATTEMPTS):
            before = self.manifest()
            after = change(before)
            if after is None:
                return before["number"]
            try:
                self._create({**after, "number": before["number"] + 1})
                return before["number"] + 1
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} attempts failed")

    # --- reading

    def _delta(self, deltas: list[dict], kind: str) -> DataFrame:
        """Rows of the deltas of a kind with ``__at``, the number of their commit."""
        schema = StructType([*self.columns.fields]) if kind == PUT else StructType([self.columns[self.key]])
        paths = [d["path"] for d in deltas if d["kind"] == kind]
        schema = schema.add("__at", "long")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _base(self, made: dict) -> DataFrame:
        return self.spark.read.schema(self.columns).parquet(made["base"]) if made["base"] else self.spark.createDataFrame([], self.columns)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that is still there."""
        return self._view(self.manifest(number))

    def _view(self, made: dict) -> DataFrame:
        # the deltas are small beside the base, which is only filtered and neither shuffled nor sorted while they can be sent to it
        names, base, deltas, key = self.columns.names, self._base(made), made["deltas"], self.key
        kinds = {d["kind"] for d in deltas}
        rows = base
        if kinds & {PUT, GONE}:
            puts, gone = self._delta(deltas, PUT), self._delta(deltas, GONE)
            last = puts.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__at")))).filter("__k = 1").drop("__k")
            if GONE in kinds:
                ends = gone.groupBy(key).agg(F.max("__at").alias("__gone"))
                last = last.join(ends, key, "left").filter(F.col("__gone").isNull() | (F.col("__at") > F.col("__gone"))).drop("__gone")
            changed = puts.select(key).unionByName(gone.select(key)).distinct()
            rows = base.join(changed, key, "left_anti").select(*names, F.lit(-1).cast("long").alias("__at")).unionByName(last.select(*names, "__at"))
        if FLAG in kinds:
            flags = self._delta(deltas, FLAG).groupBy(key).agg(F.max("__at").alias("__flag"))
            at = F.col("__at") if "__at" in rows.columns else F.lit(-1)
            # a row put after its flag has the flag that it was put with
            on = F.coalesce(F.col("__flag") > at, F.lit(False))
            rows = rows.join(flags, key, "left").withColumn(self.flag, F.when(on, True).otherwise(F.col(self.flag)))
        return rows.select(*names)

    # --- writing

    def _written(self, df: DataFrame, kind: str, number: int) -> dict:
        path = f"{self.root}/{kind}-{uuid.uuid4().hex}"
        df.withColumn("__at", F.lit(number).cast("long")).write.parquet(path)
        return {"kind": kind, "path": path}

    def _add(self, df: DataFrame, kind: str) -> int:
        # the rows are written once; only their number is the version's, so a second attempt after a conflict writes them again
        def change(before: dict) -> dict:
            return {**before, "deltas": [*before["deltas"], self._written(df, kind, before["number"] + 1)]}

        number = self.commit(change)
        if len(self.manifest()["deltas"]) >= MERGED:
            self.merge()
        return number

    def put(self, rows: DataFrame) -> int:
        """Rows by id: new ones are added, older ones of their id replaced; of several of an id one stays."""
        return self._add(rows.dropDuplicates([self.key]).select(*self.columns.names), PUT)

    def set_flag(self, ids: DataFrame) -> int:
        return self._add(ids.select(self.key).distinct(), FLAG)

    def remove(self, ids: DataFrame) -> int:
        return self._add(ids.select(self.key).distinct(), GONE)

    def replace(self, df: DataFrame) -> int:
        """All rows anew."""
        path = self._new_base(df)
        return self.commit(lambda before: {"base": path, "deltas": []})

    def _new_base(self, df: DataFrame) -> str:
        path = f"{self.root}/base-{uuid.uuid4().hex}"
        df.select(*self.columns.names).write.partitionBy(*self.parts).parquet(path)
        return path

    def size(self, path: str) -> int:
        return int(self.fs.getContentSummary(self.path(path)).getLength())

    def merge(self) -> None:
        """Many deltas become one of each kind; base and deltas become a new base if these have grown to a part of it."""
        made = self.manifest()
        deltas = made["deltas"]
        if sum(self.size(d["path"]) for d in deltas) > PART * (self.size(made["base"]) if made["base"] else 0):
            return self.compact()
        key, parts = self.key, []
        for kind in sorted({d["kind"] for d in deltas}):
            df = self._delta(deltas, kind)
            last = df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__at")))).filter("__k = 1").drop("__k")
            path = f"{self.root}/{kind}-{uuid.uuid4().hex}"
            last.write.parquet(path)  # with the numbers of their commits
            parts.append({"kind": kind, "path": path})

        def change(before: dict) -> dict | None:
            if before["base"] != made["base"] or before["deltas"][: len(deltas)] != deltas:
                return None  # merged or replaced by another
            return {**before, "deltas": [*parts, *before["deltas"][len(deltas) :]]}

        self.commit(change)

    def compact(self) -> None:
        """Base and deltas become a new base.  What is committed meanwhile stays a delta of it."""
        made = self.manifest()
        path = self._new_base(self._view(made))

        def change(before: dict) -> dict | None:
            if before["base"] != made["base"] or before["deltas"][: len(made["deltas"])] != made["deltas"]:
                return None
            return {**before, "base": path, "deltas": before["deltas"][len(made["deltas"]) :]}

        self.commit(change)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the ``keep`` newest are made of; how many folders that were.  No writer may be at work."""
        numbers = self.numbers()
        held = [self.manifest(n) for n in numbers[-keep:]]
        named = {p.rsplit("/", 1)[-1] for m in held for p in [m["base"] or "", *(d["path"] for d in m["deltas"])]}
        old = [s.getPath() for s in self.fs.listStatus(self.path(self.root)) if s.isDirectory() and s.getPath().getName() not in named | {"log"}]
        for p in old:
            self.fs.delete(p, True)
        for n in numbers[:-keep]:
            self.fs.delete(self.path(self._name(n)), False)
        return len(old)
