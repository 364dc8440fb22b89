"""What to keep of a stream of frames (STR1-STR4, VEC18, WIN3): a gate, a short window for the sharpest frame, a check for a new scene.

One step function serves the batch and the stream; its state for a camera and episode is a handful of numbers and two short arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of the gate, in milliseconds and shares.
COOLDOWN, HEARTBEAT, CHECK, WINDOW, SAMPLE = 3000, 45_000, 3000, 800, 200
CHANGED, SAME_SCENE = 0.98, 0.90


def decision(similarity: Column, apart_ms: Column, changed: float = CHANGED) -> Column:
    """The gate for a given baseline (STR1); a null similarity means that there is no baseline."""
    return (
        F.when(similarity.isNull(), "CAPTURE").when(apart_ms < COOLDOWN, "SKIP").when(similarity < changed, "CAPTURE").when(apart_ms >= HEARTBEAT, "HEARTBEAT").otherwise("SKIP")
    )


def decide(similarity: float | None, apart_ms: int, changed: float) -> str:
    if similarity is None:
        return "CAPTURE"
    if apart_ms < COOLDOWN:
        return "SKIP"
    return "CAPTURE" if similarity < changed else "HEARTBEAT" if apart_ms >= HEARTBEAT else "SKIP"


@dataclass
class Camera:
    """State of one camera in one episode."""

    changed: float = CHANGED
    same: float = SAME_SCENE
    grid: list[float] = field(default_factory=list)
    vec: list[float] = field(default_factory=list)
    stored_ms: int = 0
    checked_ms: int = -(10**15)
    sampled_ms: int = -(10**15)
    deadline_ms: int = -1
    pending: str = ""
    best: dict = field(default_factory=dict)

    def similarity(self, grid: list[float]) -> float | None:
        return float(1 - np.abs(np.subtract(self.grid, grid)).mean()) if self.grid else None

    def cosine(self, vec: list[float]) -> float:
        lengths = float(np.linalg.norm(self.vec) * np.linalg.norm(vec))
        return float(np.dot(self.vec, vec)) / lengths if lengths > 0 else 0.0

    def step(self, frame: dict) -> dict | None:
        """Take a frame (``id``, ``ts``, ``grid``, ``vec``, ``sharp``); the stored moment if one is."""
        now = frame["ts"]
        if self.deadline_ms >= 0:
            if now - self.sampled_ms < SAMPLE:
                return None
            self.sampled_ms = now
            if frame["sharp"] > self.best["sharp"]:
                self.best = frame
            if now < self.deadline_ms:
                return None
            chosen, kind = self.best, self.pending
            self.deadline_ms, self.best, self.pending = -1, {}, ""
            if kind == "CAPTURE" and self.vec and self.cosine(chosen["vec"]) >= self.same:
                return None
            self.grid, self.vec, self.stored_ms = chosen["grid"], chosen["vec"], now
            return {"id": chosen["id"], "stored_ms": now, "decision": kind}
        if now - self.checked_ms < CHECK:
            return None
        self.checked_ms = now
        kind = decide(self.similarity(frame["grid"]), now - self.stored_ms, self.changed)
        if kind != "SKIP":
            self.deadline_ms, self.sampled_ms, self.pending, self.best = now + WINDOW, now, kind, frame
        return None


FRAMES = "camera long, id long, ts long, grid array<double>, vec array<double>, sharp double"
STORED = "camera long, id long, stored_ms long, decision string"


def rows_of(pdf: pd.DataFrame) -> Iterator[dict]:
    yield from frames_of(pdf.sort_values(["ts", "id"]))


def frames_of(pdf: pd.DataFrame) -> Iterator[dict]:
    for r in pdf.itertuples(index=False):
        yield {"id": int(r.id), "ts": int(r.ts), "grid": [float(x) for x in r.grid], "vec": [float(x) for x in r.vec], "sharp": float(r.sharp)}


def moments_batch(frames: DataFrame, changed: float = CHANGED, same: float = SAME_SCENE) -> DataFrame:
    """Moments of finished episodes: ``FRAMES`` to ``STORED``.  ``camera`` is one camera's session; frames are taken in order, a few at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, camera = None, Camera(changed, same)
        for pdf in batches:
            kept = []
            for one, frame in zip(pdf["camera"], frames_of(pdf), strict=True):
                if one != now:
                    now, camera = one, Camera(changed, same)
                x = camera.step(frame)
                kept += [{"camera": one, **x}] if x else []
            yield pd.DataFrame(kept, columns=["camera", "id", "stored_ms", "decision"])

    ordered = frames.repartition("camera").sortWithinPartitions("camera", "ts", "id")
    return ordered.select("camera", "id", "ts", "grid", "vec", "sharp").mapInPandas(run, STORED)


def moments_stream(frames: DataFrame, changed: float = CHANGED, same: float = SAME_SCENE) -> DataFrame:
    """The same on a stream, its state kept between batches."""
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        camera = Camera(**json.loads(state.get[0])) if state.exists else Camera(changed, same)
        pdf = pd.concat(list(batches))
        kept = [x for f in rows_of(pdf) if (x := camera.step(f))]
        state.update((json.dumps(asdict(camera)),))
        yield pd.DataFrame([{"camera": key[0], **x} for x in kept], columns=["camera", "id", "stored_ms", "decision"])

    return frames.groupBy("camera").applyInPandasWithState(run, STORED, "state string", "append", GroupStateTimeout.NoTimeout)


def spaced(ts: list[int], least: int) -> list[bool]:
    """Which of ascending times are at least ``least`` after the last one kept (STR4)."""
    last, kept = None, []
    for t in ts:
        ok = last is None or t - last >= least
        last = t if ok else last
        kept.append(ok)
    return kept
