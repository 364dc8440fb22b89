"""Keeping a shared corpus: backlog, upsert, flags, curation, snapshots (REL10-REL17, STR11-STR13, SNK)."""

from __future__ import annotations

import json
import threading
import time
import uuid as uuids

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.moments import is_object
from .ranking import numbered

EXAMINED, BATCH = 1000, 100
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def dense_vector(raw: str = "vector"):
    """A dense vector of JSON: a bare array, or one under ``clip`` of an object, also tagged as ``dense`` (REL11)."""
    whole = F.from_json(raw, "array<double>")
    named = F.from_json(F.get_json_object(raw, "$.clip"), "array<double>")
    tagged = F.from_json(F.get_json_object(raw, "$.clip.dense"), "array<double>")
    found = F.coalesce(whole, named, tagged)
    return F.when((F.size(found) > 0) & F.forall(found, lambda x: x.isNotNull()), found)


def to_fleet(records: DataFrame) -> DataFrame:
    """Points for the shared corpus of records (``id``, ``vector`` and ``payload`` as JSON); those that can't be mapped are left out (REL11)."""
    kept = records.filter(F.col("id").rlike(UUID) & is_object(F.col("payload"))).withColumn("v", dense_vector())
    fields = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: k != "synced")
    return kept.filter(F.col("v").isNotNull()).select("id", F.col("v").alias("vector"), fields.alias("payload"))


def unsynced(df: DataFrame, limit: int) -> DataFrame:
    """The first unsynced frames in id order."""
    return df.filter((F.col("type") == "frame") & ~F.coalesce("synced", F.lit(False))).orderBy("id").limit(limit)


def backlog(df: DataFrame, mappable, limit: int = BATCH, examined: int = EXAMINED) -> DataFrame:
    """The first ``limit`` mappable rows of the first ``examined`` unsynced frames, in id order (REL10)."""
    return unsynced(df, examined).filter(mappable).orderBy("id").limit(limit)


def mark_synced(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Exactly the rows of ``ids`` become synced; nothing else changes (REL12)."""
    flagged = ids.select("id").distinct().withColumn("__flag", F.lit(True))
    return df.join(flagged, "id", "left").withColumn("synced", F.when(F.col("__flag"), True).otherwise(F.col("synced"))).drop("__flag")


def upsert(target: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows by key: new ones are added, known ones replaced, none is doubled (REL13, SNK6)."""
    return target.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.dropDuplicates([key]))


def approve(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``df`` with the rows of ``ids`` curated (REL14)."""
    known = ids.select("id").distinct().withColumn("__ok", F.lit(True))
    return df.join(known, "id", "left").withColumn("curated", F.coalesce("__ok", "curated")).drop("__ok")


def curate(inbox: DataFrame, shelf: DataFrame) -> DataFrame:
    """The shelf after curated rows that have a vector were moved there (REL15)."""
    return upsert(shelf, inbox.filter(F.col("curated") & F.col("clip").isNotNull()))


def seed(df: DataFrame) -> DataFrame:
    """Frames as the first points of a shared corpus: running ids and marked labels (REL16)."""
    rows = df.filter((F.col("type").isNull() | (F.col("type") == "frame")) & F.col("clip").isNotNull())
    label = F.concat(F.lit("FLEET: "), F.coalesce(F.nullif("label", F.lit("")), F.col("moment_id").cast("string")))
    return numbered(rows.select("id", label.alias("label")), [], ["id"], "seq").select("seq", "id", "label")


# --- snapshots: a folder is staged, checked, and only then the current one


#: Seconds after which a lease that wasn't given back has ended.
LEASE = 600.0

# a rename onto a name that must be free is one step on a shared file system, but two on that of a machine
_local = threading.Lock()


class Snapshots:
    """A folder of snapshots with a pointer to the current one.  A failed pull leaves the pointer where it was."""

    LOADED, EMPTY, UNREACHABLE, BUSY = "loaded", "empty", "unreachable", "busy"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        at = self.path(f"{self.root}/current")
        return self.spark.read.text(str(at)).first().value if self.fs.exists(at) else None

    def stage(self, df: DataFrame) -> str:
        """Write a snapshot beside the current one."""
        name = f"{self.root}/snapshot-{uuids.uuid4().hex}"
        df.write.parquet(name)
        return name

    def promote(self, name: str) -> None:
        """The pointer is written aside and renamed over the old one in one step, so it always names a whole snapshot."""
        aside, at = self.path(f"{self.root}/current-{uuids.uuid4().hex}"), self.path(f"{self.root}/current")
        out = self.fs.create(aside, True)
        out.write(bytearray(name.encode()))
        out.close()
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), hadoop).rename(aside, at, options)

    def delete(self, name: str) -> bool:
        """Remove a snapshot that isn't the current one (SRC10)."""
        if name == self.current():
            raise ValueError("the current snapshot can't be deleted")
        return bool(self.fs.delete(self.path(name), True))

    def size(self, name: str) -> int:
        return int(self.fs.getContentSummary(self.path(name)).getLength())

    def extract(self, source: str, name: str) -> bool:
        """A copy of the file ``source`` under ``name``, made anew only if its size differs; written aside and renamed (SRC11)."""
        at, of = self.path(f"{self.root}/{name}"), self.path(source)
        there = of.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if self.fs.exists(at) and self.fs.getFileStatus(at).getLen() == there.getFileStatus(of).getLen():
            return False
        aside = self.path(f"{self.root}/{name}-{uuids.uuid4().hex}")
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileUtil.copy(there, of, self.fs, aside, False, hadoop)
        if self.fs.exists(at):
            self.fs.delete(at, False)
        return bool(self.fs.rename(aside, at))

    def pull(self, source: str) -> tuple[str, int | None]:
        """Copy a snapshot, count it, and make it the current one if it has rows: (state, rows)."""
        try:
            staged = self.stage(self.spark.read.parquet(source))
            rows = self.spark.read.parquet(staged).count()
        except Exception as e:  # any failure of the source or of the copy leaves the current snapshot alone
            return f"{self.UNREACHABLE}: {json.dumps(str(e)[:200])}", None
        if not rows:
            self.fs.delete(self.path(staged), True)
            return self.EMPTY, 0
        self.promote(staged)
        return self.LOADED, rows

    # --- one pull at a time (STR13)

    def acquire(self, seconds: float = LEASE) -> str | None:
        """The token of a lease on this folder, or None if another holds one; a lease that wasn't given back ends after ``seconds``.

        The lease is a file with the holder's token and end, made aside and renamed onto a name that must be free.  One that has ended is renamed
        away first, which only one of several can do.
        """
        at, token = self.path(f"{self.root}/lease"), uuids.uuid4().hex
        with _local:
            if self.fs.exists(at):
                held = self.spark.read.text(str(at)).first()
                if held is not None and float(held.value.split(" ")[1]) > time.time():
                    return None
                if not self.fs.rename(at, self.path(f"{self.root}/lease-{token}-ended")):
                    return None
                self.fs.delete(self.path(f"{self.root}/lease-{token}-ended"), False)
            aside = self.path(f"{self.root}/lease-{token}")
            out = self.fs.create(aside, True)
            out.write(bytearray(f"{token} {time.time() + seconds}".encode()))
            out.close()
            if self.fs.exists(at) or not self.fs.rename(aside, at):
                self.fs.delete(aside, False)
                return None
        return token

    def release(self, token: str) -> bool:
        """Give a lease back; one that another has taken over since is left alone."""
        at = self.path(f"{self.root}/lease")
        with _local:
            held = self.spark.read.text(str(at)).first() if self.fs.exists(at) else None
            return bool(held is not None and held.value.split(" ")[0] == token and self.fs.delete(at, False))

    def pull_alone(self, source: str, seconds: float = LEASE) -> tuple[str, int | None]:
        """``pull``, unless another pull is at work: then nothing is staged and the state is ``BUSY``."""
        token = self.acquire(seconds)
        if token is None:
            return self.BUSY, None
        try:
            return self.pull(source)
        finally:
            self.release(token)

    def load(self) -> DataFrame:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"{self.root} has no current snapshot")
        return self.spark.read.parquet(name)
