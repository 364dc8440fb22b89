"""Sending events to viewers (SNK8, SNK9) and taking only what a slow receiver can bear (STR3, STR4, STR10)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def push(stream: DataFrame, place: str, send: Callable[[str, list[str]], None], size: int = 100) -> None:
    """Send the column ``event`` of a stream for what there is now, ``size`` events at a time, from the tasks that have them.

    Each message has a name of its batch, its task's part of it, and its number, so a receiver can tell one that a task that is run again sends
    once more.  A receiver that fails loses that message, and the stream goes on; a batch is not sent again once its number is written down.
    """

    def each(batch: DataFrame, number: int) -> None:
        def tell(rows: Iterator) -> None:
            waiting: list[str] = []
            part, sent = TaskContext.get().partitionId(), 0

            def out() -> None:
                try:
                    send(f"{number}-{part}-{sent}", waiting)
                except OSError:
                    pass  # a viewer that is away misses the message

            for r in rows:
                waiting.append(r.event)
                if len(waiting) == size:
                    out()
                    waiting, sent = [], sent + 1
            if waiting:
                out()

        # in an order of their own, so that a part that is run again cuts the same messages
        batch.select("event").sortWithinPartitions("event").foreachPartition(tell)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def file_viewer(folder: str) -> Callable[[str, list[str]], None]:
    """A viewer that keeps each message as a file of a shared folder, one line for each event, through the file system that the folder names."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def send(name: str, events: list[str]) -> None:
        import pyarrow.fs

        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(path, recursive=True)
        lines = [json.dumps({"message": name, "part": k, "event": e}) for k, e in enumerate(events)]
        with fs.open_output_stream(f"{path}/{name}.json") as out:
            out.write(("\n".join(lines) + "\n").encode())

    return send


PACED = "key long, id long, ts long"


def paced_rows(rows: Iterator[tuple[int, int, int]], free_at: int) -> Iterator[tuple[int, int, int]]:
    """Of rows (id, time, how long one holds the lane) in order those that find the lane free, with when it is free again."""
    for one, ts, hold in rows:
        if ts >= free_at:
            free_at = ts + hold
            yield one, ts, free_at


def paced(frames: DataFrame) -> DataFrame:
    """Of a stream of frames (``key``, ``id``, ``ts``, ``hold``) those that are taken: a frame that comes while the last one holds the lane is dropped.

    With a ``hold`` that is always the same this caps the rate (STR4); with the time that each frame's work takes it drops the latest while
    the lane is busy (STR10).  The state of a key is one number.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts", "id"])
        kept = list(paced_rows(pdf[["id", "ts", "hold"]].itertuples(index=False, name=None), state.get[0] if state.exists else -(2**62)))
        if kept:
            state.update((int(kept[-1][2]),))
        yield pd.DataFrame([(key[0], one, ts) for one, ts, _ in kept], columns=["key", "id", "ts"])

    return frames.groupBy("key").applyInPandasWithState(run, PACED, "free_at long", "append", GroupStateTimeout.NoTimeout)


def newest_generation(frames: DataFrame) -> DataFrame:
    """Of a stream of frames (``key``, ``id``, ``ts``, ``generation``) those that aren't of an older session than the newest seen (STR3)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts", "id"])
        newest = pdf["generation"].cummax().clip(lower=state.get[0] if state.exists else -(2**62))
        state.update((int(newest.iloc[-1]),))
        kept = pdf[pdf["generation"] == newest]
        yield pd.DataFrame({"key": key[0], "id": kept["id"], "ts": kept["ts"]})

    return frames.groupBy("key").applyInPandasWithState(run, PACED, "newest long", "append", GroupStateTimeout.NoTimeout)
