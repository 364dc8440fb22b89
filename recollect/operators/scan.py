"""Filters, scrolls and pages over a collection (FLT, REL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(since: int | Column | None = None, until: int | Column | None = None, ts: str = "timestamp_ms") -> Column:
    """Both bounds belong to the window; None leaves a side open (FLT1, FLT8)."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col(ts) >= since)
    if until is not None:
        keep = keep & (F.col(ts) <= until)
    return keep


def of_type(df: DataFrame, kind: str | None, since=None, until=None, label: str | None = None) -> DataFrame:
    """By type, window and exact label; an empty label filters nothing (FLT1-FLT3).  Conditions on columns reach the scan."""
    if kind is not None:
        df = df.filter(F.col("type") == kind)
    if since is not None or until is not None:
        df = df.filter(in_window(since, until))
    return df.filter(F.col("label") == label) if label else df


def unsynced(df: DataFrame) -> DataFrame:
    """Frames that aren't known to be synced; an absent flag counts as not synced (FLT4)."""
    return df.filter((F.col("type") == "frame") & ~F.coalesce("synced", F.lit(False)))


def newest(df: DataFrame, limit: int, ts: str = "timestamp_ms") -> DataFrame:
    """The newest rows, newest first: filters come before, the limit after the sort (REL5, REL6)."""
    return df.orderBy(F.desc(ts), "id").limit(limit)


def timeline(df: DataFrame, limit: int = 500) -> DataFrame:
    """The newest frames, oldest first (REL4)."""
    return newest(of_type(df, "frame"), limit).orderBy("timestamp_ms", F.desc("id"))


def page_after(df: DataFrame, key: str, cursor: int | None, limit: int) -> DataFrame:
    """A page of rows in key order, from the one after ``cursor`` (REL7)."""
    return (df if cursor is None else df.filter(F.col(key) > cursor)).orderBy(key).limit(limit)


def keyword_hits(df: DataFrame, text: str, words: str, limit: int = 5) -> DataFrame:
    """Rows whose text contains ``words``, in id order (FLT6)."""
    return df.filter(F.col(text).contains(words)).orderBy("id").limit(limit)


def last_of_each(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key: a queue that drops its oldest (SNK10, REL18)."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("id"))
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def verified_label(label: Column, cos: Column, gate: float) -> Column:
    """The label where it is verified, else '' (FLT12)."""
    return F.when(cos >= gate, label).otherwise("")
