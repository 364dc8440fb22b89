"""Automata over the rows of a key in order of event time, on streams: tracks, segments of speech, the frame gate (STR4, STR5, STR8, SRC4, SRC5).

Rows of a stream come in batches that may split a frame or bring an older row after a newer one.  So the rows of a key wait in its state
until the watermark has passed them; a timer at the oldest one's time wakes the key, and all rows that the watermark has passed are folded
in order.  The result thus doesn't depend on how a stream is cut into batches.  What a key keeps is its rows of the watermark's delay
and its automaton's state, never its history.  Rows are packed before they are shuffled, since Spark hands the rows of a key to Python one by one,
and wait packed, some thousands in order of time as one value; small automata of many keys share a bucket's state, since a value of the state store
costs far more than a row.  A key takes them up a part at a time.  A row that comes after its key has been folded past its time is left out.

Each automaton's step is a plain function or class that the batch twin uses as well (``folded`` here, ``tracker.tracked`` for tracks).
"""

from __future__ import annotations

import json
from abc import abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.intervals import slot
from ..operators.pairs import in_blocks
from .run import available_now, shared_folder
from .tracker import MISSED, Frames

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep state of several kinds for each key, which the provider on disk can hold."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def ended(rows: DataFrame, at: Callable[[str], object]) -> tuple[DataFrame, Callable[[], None]]:
    """A stream, and how to give it a last row ``{column: at(column)}``."""
    spark, place = rows.sparkSession, shared_folder(rows.sparkSession)
    end = spark.createDataFrame([tuple(at(c) for c in rows.columns)], rows.schema)
    end.limit(0).write.parquet(place)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(place)), lambda: end.write.mode("append").parquet(place)


#: Rows that come out together; rows that are put in order at once; rows of a value of the state.
AT_ONCE, ORDERED, PACKED = 10_000, 1 << 18, 1 << 13
#: When a stream that ends has its last row.
LAST = datetime(2200, 1, 1)


def to_its_end(made: Callable[[DataFrame], DataFrame], rows: DataFrame, at: str) -> DataFrame:
    """What ``made(stream)`` gives of a stream after a last row has moved the watermark past all others; that row's own key is null."""
    both, then = ended(rows, lambda c: LAST if c == at else None)
    with state_on_disk(rows.sparkSession):
        return available_now(made(both), then=then)


def packed(rows: pd.DataFrame | pa.Table, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows, schema, preserve_index=False)
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table.select(schema.names).cast(schema))
    return sink.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def by_time(tables: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(tables).combine_chunks()
    return rows.take(pc.sort_indices(rows["at_ms"]))


def values(rows: pa.Table, schema: pa.Schema) -> Iterator[tuple[int, bytes]]:
    """Rows in order of time as values of the state, with the time of each value's first."""
    for a in range(0, rows.num_rows, PACKED):
        yield rows["at_ms"][a].as_py(), packed(rows.slice(a, PACKED), schema)


class InOrder(StatefulProcessor):
    """Rows (``at_ms`` and the columns of ``schema``) of a key in order of event time; they come packed, in the column ``rows``."""

    #: What waits of each row, ``at_ms long`` first, and the columns that settle ties of time.
    schema: str
    order: list[str]
    #: The columns that come out, the key first.
    out: list[str]
    #: ``schema`` as Arrow has it, set where the stream is made.
    arrow: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a map, as each value that is put to a list makes the store read the whole list
        self.waiting = handle.getMapState("waiting", "least long, number long", "rows binary")
        self.number = handle.getValueState("number", "number long")
        self.folded = handle.getValueState("folded", "until long")
        self.open(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.folded.get()[0] if self.folded.exists() else None
        firsts, held, n = [], [], 0
        for pdf in rows:
            for value in pdf["rows"]:
                table = unpacked(value)
                table = table if until is None else table.filter(pc.greater(table["at_ms"], until))
                held.append(table)
                n += table.num_rows
                if n >= ORDERED:
                    firsts.append(self.wait(held))
                    held, n = [], 0
        if n:
            firsts.append(self.wait(held))
        if firsts:
            self.handle.registerTimer(min(firsts))
        yield pd.DataFrame(columns=self.out)

    def wait(self, tables: list[pa.Table]) -> int:
        """Put rows into the state; the time of the first."""
        rows = by_time(tables)
        number = int(self.number.get()[0]) if self.number.exists() else 0
        for number, (least, value) in enumerate(values(rows, self.arrow), number):
            self.waiting.updateValue((least, number), (value,))
        self.number.update((number + 1,))
        return rows["at_ms"][0].as_py()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((int(least), int(number)) for least, number in self.waiting.keys()) if self.waiting.exists() else []  # noqa: SIM118
        due, late, ahead = [k for k in waiting if k[0] <= passed], [k[0] for k in waiting if k[0] > passed], []
        yield from self.fold(key, self.parts(due, passed, ahead), passed)
        if due:
            for k in due:
                self.waiting.removeKey(k)
            late += [self.wait(ahead)] if ahead else []
            if late:
                self.handle.registerTimer(min(late))
        self.folded.update((passed,))

    def parts(self, due: list[tuple[int, int]], passed: int, ahead: list[pa.Table]) -> Iterator[pa.Table]:
        """The rows that the watermark has passed, a part after the other in time, those of a time in one; the others are put into ``ahead``.

        ``due`` are the places of values in the state, in order of their first rows.
        """
        held, n, left = [], 0, 0
        for k, place in enumerate(due):
            held.append(unpacked(self.waiting.getValue(place)[0]))
            n += held[-1].num_rows
            more = k + 1 < len(due)
            if more and n < max(ORDERED, 2 * left):
                continue
            table = by_time(held)
            cut = int(np.searchsorted(table["at_ms"].to_numpy(), due[k + 1][0] if more else passed + 1))
            if cut:
                yield table.slice(0, cut)
            held = [table.slice(cut)]
            n = left = table.num_rows - cut
        ahead += [x for x in held if x.num_rows]

    def together(self, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        """Rows that come out, some at a time."""
        rows = []
        for x in found:
            rows.append(x)
            if len(rows) == AT_ONCE:
                yield pd.DataFrame(rows, columns=self.out)
                rows = []
        yield pd.DataFrame(rows, columns=self.out)

    @abstractmethod
    def open(self, handle: StatefulProcessorHandle) -> None:
        """Make the automaton's state."""

    @abstractmethod
    def fold(self, key: tuple, parts: Iterator[pa.Table], passed: int) -> Iterator[pd.DataFrame]:
        """What comes out of all parts, one after the other; also called without any when a timer of the automaton is due."""

    def close(self) -> None:
        pass


def on_stream(rows: DataFrame, key: str, processor: InOrder, out: str, delay: str = "1 hour") -> DataFrame:
    """``processor`` on a stream of ``key``, ``at`` (a timestamp) and its columns."""
    schema = processor.arrow = to_arrow_schema(StructType.fromDDL(processor.schema))

    def of_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_blocks(batches, ORDERED):
            table = table.take(pc.sort_indices(table[key])).combine_chunks()
            keys = pc.run_end_encode(table[key].combine_chunks())
            begins = [0, *keys.run_ends.to_pylist()]
            pieces = [(k, a, min(a + PACKED, end)) for k, (begin, end) in enumerate(pairwise(begins)) for a in range(begin, end, PACKED)]
            for p in range(0, len(pieces), 64):
                some = pieces[p : p + 64]
                of_some = pa.array([packed(table.slice(a, end - a), schema) for _, a, end in some], pa.binary())
                yield pa.RecordBatch.from_arrays([keys.values.take(pa.array([k for k, _, _ in some])), of_some], names=[key, "rows"])

    timed = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay).filter("at_ms IS NOT NULL")
    by_key = timed.select(key, *schema.names).mapInArrow(of_key, StructType([rows.schema[key]]).add("rows", "binary"))
    return by_key.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventTime")


# --- tracks

#: Milliseconds of a tick on the clock of event time.
TICK = 1000


class Follow(InOrder):
    """Tracks of numbered frames: a camera's live tracks are a map, and a timer ends those unseen for more than ``MISSED`` ticks."""

    schema = "at_ms long, tick long, det int, label string, score double, l double, t double, r double, b double"
    order = ["det", "label", "score"]
    out = ["camera", "tick", "det", "track", "sightings"]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "track long", "label string, score double, l double, t double, r double, b double, seen long, sightings long")
        self.made = handle.getValueState("made", "made long")

    def fold(self, key: tuple, parts: Iterator[pa.Table], passed: int) -> Iterator[pd.DataFrame]:
        before = {int(k[0]): tuple(v) for k, v in self.live.iterator()}
        tracks = [{"id": number, "label": label, "score": score, "box": tuple(box), "seen": int(seen), "sightings": int(sightings)} for number, (label, score, *box, seen, sightings) in before.items()]
        frames = Frames(int(self.made.get()[0]) if self.made.exists() else 0, tracks)
        for rows in parts:
            rows = rows.filter(rows["det"].is_valid())  # a row without a detection says only that time goes on
            if not rows.num_rows:
                continue
            label = rows["label"].combine_chunks().dictionary_encode("encode")
            names = label.dictionary.to_pylist()
            sizes = np.empty(len(names), np.int64)
            sizes[sorted(range(len(names)), key=lambda k: (names[k] is None, names[k] or ""))] = np.arange(len(names))
            code = label.indices.to_numpy()
            tick, at, det, score, *box = (rows[c].to_numpy() for c in ("tick", "at_ms", "det", "score", *"ltrb"))
            order = np.lexsort((score, sizes[code], det, at, tick))
            tick, det = tick[order], det[order]
            track, sightings = frames.take(tick, code[order].astype(np.int64), names, score[order], np.array(box)[:, order])
            yield pd.DataFrame(dict(zip(self.out, (np.full(len(tick), key[0]), tick, det, track, sightings), strict=True)))
        # tracks that no later frame can meet end here, even if the camera is silent from now on
        live = {t["id"]: t for t in frames.tracks if passed < (t["seen"] + MISSED + 1) * TICK}
        for number in before.keys() - live.keys():
            self.live.removeKey((number,))
        for number, t in live.items():
            value = (t["label"], float(t["score"]), *map(float, t["box"]), t["seen"], t["sightings"])
            if before.get(number) != value:
                self.live.updateValue((number,), value)
        if live:
            self.handle.registerTimer((max(t["seen"] for t in live.values()) + MISSED + 1) * TICK)
        self.made.update((frames.made,))
        yield pd.DataFrame(columns=self.out)


def tracks_stream(detections: DataFrame) -> DataFrame:
    """``tracker.tracked(numbered=True)`` on a stream of ``camera``, ``tick``, ``det``, ``label``, ``score``, ``box``; a tick is a second of event time."""
    rows = detections.select("camera", "tick", F.col("det").cast("int").alias("det"), "label", F.col("score").cast("double").alias("score"), *[F.col(f"box.{c}").alias(c) for c in "ltrb"])
    rows = rows.withColumn("at", F.timestamp_millis(F.col("tick") * TICK))
    return on_stream(rows, "camera", Follow(), "camera long, tick long, det int, track long, sightings long", "0 seconds")


# --- folds of one small state


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, out: str) -> DataFrame:
    """The batch form of an automaton: ``start()`` makes one for each key, ``step(row)`` and ``end()`` give what comes out.

    A key's rows are taken in order, a few at a time, so memory doesn't grow with a key's history.
    """
    names = [f.name for f in StructType.fromDDL(out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, automaton = None, None
        for pdf in batches:
            found: list[tuple] = []
            for r in pdf.itertuples(index=False):
                one = getattr(r, key)
                if automaton is None or one != now:
                    found += [(now, *x) for x in automaton.end()] if automaton else []
                    now, automaton = one, start()
                found += [(now, *x) for x in automaton.step(r)]
            yield pd.DataFrame(found, columns=names)
        if automaton:
            yield pd.DataFrame([(now, *x) for x in automaton.end()], columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


#: Parts that the keys of small automata are dealt to.
BUCKETS = 512


class Fold(InOrder):
    """Automata whose state is a few numbers, those of a bucket's keys together: they are kept as JSON, and a timer ends what silence ends."""

    def __init__(self, start: Callable, revive: Callable, key: str, schema: str, order: list[str], out: list[str]):
        self.start, self.revive, self.key, self.schema, self.order, self.out = start, revive, key, f"{schema}, {key} long", order, out

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def fold(self, key: tuple, parts: Iterator[pa.Table], passed: int) -> Iterator[pd.DataFrame]:
        yield from self.together(self.steps(parts, passed))

    def steps(self, parts: Iterator[pa.Table], passed: int) -> Iterator[tuple]:
        kept = json.loads(self.state.get()[0]) if self.state.exists() else []
        automata = {one: self.revive(state) for one, state in kept}
        for rows in parts:
            for r in rows.to_pandas().sort_values([self.key, "at_ms", *self.order]).itertuples(index=False):
                one = getattr(r, self.key)
                one = None if pd.isna(one) else int(one)
                if one not in automata:
                    automata[one] = self.start()
                for x in automata[one].step(r):
                    yield (one, *x)
        wake = None
        for one, automaton in automata.items():
            due = automaton.due_ms()
            if due is None:
                continue
            if passed > due:
                for x in automaton.end():
                    yield (one, *x)
            else:
                wake = due if wake is None else min(wake, due)
        if wake is not None:
            self.handle.registerTimer(wake + 1)
        self.state.update((json.dumps([(one, automaton.kept()) for one, automaton in automata.items()]),))


def folded_stream(rows: DataFrame, processor: Fold, out: str) -> DataFrame:
    """``processor`` on a stream of its key, ``at`` and its columns; rows without a key, as the last one, have a bucket of their own."""
    bucket = F.when(F.col(processor.key).isNull(), -1).otherwise(F.pmod(F.xxhash64(processor.key), F.lit(BUCKETS))).cast("long")
    return on_stream(rows.withColumn("bucket", bucket), "bucket", processor, out)


@dataclass
class Speech:
    """Segments of speech (STR8): opened by a loud chunk, kept open by fainter ones, closed by silence, cut when too long, dropped when too short."""

    loud: float
    faint: float
    silence_ms: int = 500
    least_ms: int = 250
    longest_ms: int = 10_000
    open: bool = False
    start_ms: int = 0
    last_ms: int = 0
    chunks: int = 0

    def end(self) -> list[tuple]:
        """Close the segment there is; it comes out if it is long enough."""
        was, self.open = self.open, False
        return [(self.start_ms, self.last_ms, self.chunks)] if was and self.last_ms - self.start_ms >= self.least_ms else []

    def kept(self) -> dict:
        return asdict(self)

    def due_ms(self) -> int | None:
        return self.last_ms + self.silence_ms if self.open else None

    def step(self, chunk) -> list[tuple]:
        at, level = int(chunk.at_ms), chunk.level
        if level is None or not level >= self.faint:
            return []
        out: list[tuple] = []
        going = self.open and at - self.last_ms <= self.silence_ms
        if going and at - self.start_ms < self.longest_ms:
            self.last_ms, self.chunks = at, self.chunks + 1
            return out
        out = self.end()
        if going or level >= self.loud:  # speech that is cut goes on in a segment of its own
            self.open, self.start_ms, self.last_ms, self.chunks = True, at, at, 1
        return out


SPEECH = "at_ms long, event_id long, level double"
SEGMENT = "key long, start_ms long, last_ms long, chunks long"


def segments_batch(chunks: DataFrame, loud: float, faint: float, **limits: int) -> DataFrame:
    """Segments of ``key``, ``at_ms``, ``event_id``, ``level``; silent chunks never reach Python."""
    return folded(chunks.filter(F.col("level") >= faint), "key", ["at_ms", "event_id"], lambda: Speech(loud, faint, **limits), SEGMENT)


def segments_stream(chunks: DataFrame, loud: float, faint: float, **limits: int) -> DataFrame:
    """The same on a stream, ``at`` being a timestamp; a segment comes out as soon as the watermark shows the silence after it."""
    processor = Fold(lambda: Speech(loud, faint, **limits), lambda s: Speech(**s), "key", SPEECH, ["event_id"], ["key", "start_ms", "last_ms", "chunks"])
    # a row without a level says only that time goes on, which the watermark must see
    return folded_stream(chunks.filter(F.coalesce(F.col("level") >= faint, F.lit(True))), processor, SEGMENT)


@dataclass
class LegacyGate:
    """The older gate of frames (STR4, SRC4): some time apart, and different from the last one accepted or overdue; only accepting moves the baseline."""

    apart_ms: int = 3000
    alike: float = 0.85
    forced_ms: int = 12_000
    grid: list[float] = field(default_factory=list)
    last_ms: int | None = None

    def kept(self) -> dict:
        return asdict(self)

    def due_ms(self) -> None:
        return None

    def end(self) -> list[tuple]:
        return []

    def step(self, frame) -> list[tuple]:
        at, grid = int(frame.at_ms), [float(x) for x in frame.grid]
        if self.last_ms is not None:
            since = at - self.last_ms
            if since < self.apart_ms:
                return []
            similarity = round(float(1 - np.abs(np.subtract(self.grid, grid)).mean()), 6)
            if similarity > self.alike and since < self.forced_ms:
                return []
        self.grid, self.last_ms = grid, at
        return [(int(frame.id), at)]


ACCEPTED = "camera long, id long, at_ms long"


def accepted_batch(frames: DataFrame, **limits) -> DataFrame:
    """Accepted frames of ``camera``, ``id``, ``at_ms``, ``grid``."""
    return folded(frames, "camera", ["at_ms", "id"], lambda: LegacyGate(**limits), ACCEPTED)


def accepted_stream(frames: DataFrame, **limits) -> DataFrame:
    """The same on a stream, ``at`` being a timestamp."""
    processor = Fold(lambda: LegacyGate(**limits), lambda s: LegacyGate(**s), "camera", "at_ms long, id long, grid array<double>", ["id"], ["camera", "id", "at_ms"])
    return folded_stream(frames, processor, ACCEPTED)


@dataclass
class App:
    """The app's state machine (STR15): an event that fits no move from the state changes nothing."""

    moves: dict[str, str]
    state: str

    def kept(self) -> dict:
        return {"state": self.state}

    def due_ms(self) -> None:
        return None

    def end(self) -> list[tuple]:
        return []

    def step(self, row) -> list[tuple]:
        after = self.moves.get(f"{self.state}/{row.event}")
        if after is None:
            return []
        self.state = after
        return [(int(row.event_id), after)]


MOVED = "key long, event_id long, state string"


def states_batch(events: DataFrame, moves: dict[str, str], start: str) -> DataFrame:
    """Each move of ``key``, ``at_ms``, ``event_id``, ``event`` and the state after it."""
    return folded(events, "key", ["at_ms", "event_id"], lambda: App(moves, start), MOVED)


def states_stream(events: DataFrame, moves: dict[str, str], start: str) -> DataFrame:
    """The same on a stream, ``at`` being a timestamp."""
    processor = Fold(lambda: App(moves, start), lambda s: App(moves, **s), "key", "at_ms long, event_id long, event string", ["event_id"], ["key", "event_id", "state"])
    return folded_stream(events, processor, MOVED)


# --- the nearest frame


def nearest_stream(heard: DataFrame, frames: DataFrame, tolerance_ms: int, delay: str = "1 hour") -> DataFrame:
    """``intervals.nearest`` on two streams: ``a_id``, ``a_ts`` with the nearest ``b_id``, ``b_ts`` within the tolerance (STR9, JON7).

    Both sides wait in the join's state only as long as a partner may come; a row is given out when the watermark has passed all that could be
    nearer, with nulls if none came.
    """
    a = heard.select("a_id", "a_ts", F.timestamp_millis("a_ts").alias("a_at")).withWatermark("a_at", delay)
    b = frames.select("b_id", "b_ts", F.timestamp_millis("b_ts").alias("b_at")).withWatermark("b_at", delay)
    # a row looks into its slot of time and the two beside it, so the join is by slot
    a = a.withColumn("slot", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: slot(F.col("a_ts"), tolerance_ms) + k)))
    b = b.withColumn("b_slot", slot(F.col("b_ts"), tolerance_ms))
    reach = F.expr(f"INTERVAL {tolerance_ms} MILLISECONDS")
    near = a.join(b, (F.col("slot") == F.col("b_slot")) & (F.col("b_at") >= F.col("a_at") - reach) & (F.col("b_at") <= F.col("a_at") + reach), "leftOuter")
    order = F.when(F.col("b_id").isNotNull(), F.struct(F.abs(F.col("a_ts") - F.col("b_ts")), F.col("b_ts"), F.col("b_id")))
    found = near.groupBy("a_id", "a_ts", F.window("a_at", "1 minute")).agg(F.min(order).alias("o"))
    return found.select("a_id", "a_ts", F.col("o.b_id").alias("b_id"), F.col("o.b_ts").alias("b_ts"))


def nearest_to_its_end(heard: DataFrame, frames: DataFrame, tolerance_ms: int) -> DataFrame:
    """``nearest_stream`` after a last row on both sides has moved the watermark past all others."""
    last = int(LAST.replace(tzinfo=UTC).timestamp() * 1000)
    a, then_a = ended(heard, lambda c: last if c == "a_ts" else None)
    b, then_b = ended(frames, lambda c: last if c == "b_ts" else None)

    def then() -> None:
        then_a()
        then_b()

    return available_now(nearest_stream(a, b, tolerance_ms), then=then).filter("a_id IS NOT NULL")
