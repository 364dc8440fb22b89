"""Tracks of objects over the frames of a camera (STR5): detections are claimed by tracks of their label, best overlap first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least overlap of a track's box, and ticks after which an unseen track ends (fixed values).
OVERLAP, MISSED = 0.4, 15


def overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


class Tracker:
    def __init__(self):
        self.tracks: list[dict] = []
        self.made, self.tick = 0, 0

    def update(self, detections: list[dict], tick: int | None = None) -> list[tuple[int, int]]:
        """Take a frame's detections (``label``, ``box``, ``score``); for each its track and that track's sightings.

        ``tick`` is the frame's number, the next one if it is left out; frames without detections need not be taken.
        """
        before, self.tick = self.tick, self.tick + 1 if tick is None else tick
        tick = self.tick
        if tick != before + 1:  # else the last update has dropped those
            self.tracks = [t for t in self.tracks if tick - 1 - t["seen"] <= MISSED]
        tracks, pairs = self.tracks, []
        of_label: dict[str, list] = {}
        for k, track in enumerate(tracks):
            of_label.setdefault(track["label"], []).append((k, track["box"]))
        for d, x in enumerate(detections):
            l, t, r, b = box = x["box"]
            for k, other in of_label.get(x["label"], ()):
                l2, t2, r2, b2 = other
                # boxes that don't meet have no overlap, and most don't
                if l2 < r and l < r2 and t2 < b and t < b2 and (s := overlap(other, box)) >= OVERLAP:
                    pairs.append((-s, d, k))
        track_of: dict[int, dict] = {}
        taken: set[int] = set()
        for _, d, k in sorted(pairs):
            if d in track_of or k in taken:
                continue
            track_of[d] = tracks[k]
            taken.add(k)
            track_of[d].update(box=detections[d]["box"], score=detections[d]["score"], seen=tick, sightings=track_of[d]["sightings"] + 1)
        for d, x in enumerate(detections):
            if d not in track_of:
                self.made += 1
                track_of[d] = {"id": self.made, "label": x["label"], "box": x["box"], "score": x["score"], "seen": tick, "sightings": 1}
                tracks.append(track_of[d])
        self.tracks = [t for t in tracks if tick - t["seen"] <= MISSED]
        return [(track_of[d]["id"], track_of[d]["sightings"]) for d in range(len(detections))]


#: Pairs of boxes that are compared at once.
PAIRS = 1 << 20


class Frames:
    """What ``Tracker`` does, over many frames at once: all pairs of boxes that may meet are compared as arrays, and only those that overlap enough are taken one by one."""

    def __init__(self, made: int, tracks: list[dict]):
        self.made, self.tracks = made, sorted(tracks, key=lambda t: t["id"])

    def take(self, tick: np.ndarray, code: np.ndarray, labels: list, score: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Detections in order of their frames, no frame cut: ``code`` is the place of a label in ``labels``, ``box`` has four rows; for each its track and that track's sightings."""
        old, n = self.tracks, len(self.tracks) + len(tick)
        places = {x: k for k, x in enumerate(labels)}
        codes = [places.setdefault(t["label"], len(places)) for t in old]
        code = np.concatenate([np.array(codes, np.int64), code])
        seen = np.concatenate([np.array([t["seen"] for t in old], np.int64), tick])
        box = np.concatenate([np.array([t["box"] for t in old], np.float64).reshape(-1, 4).T, box], axis=1)
        later, earlier, s = self.alike(seen, code, box, len(old))
        order = np.lexsort((later, -s, seen[later]))
        later, earlier, s = later[order], earlier[order], s[order]
        # a detection that overlaps two tracks equally takes the older one
        ties = np.flatnonzero((later[1:] == later[:-1]) & (s[1:] == s[:-1]))
        ends = dict(zip(ties.tolist(), (ties + 2).tolist(), strict=True))
        root, sightings = list(range(n)), [t["sightings"] for t in old] + [1] * len(tick)
        taken, claimed = bytearray(n), bytearray(n)
        later, earlier = later.tolist(), earlier.tolist()
        for e in range(len(later)):
            if e in ends:
                end = ends[e]
                while end - 1 in ends:
                    end = ends[end - 1]
                earlier[e:end] = sorted(earlier[e:end], key=root.__getitem__)
            d, k = later[e], earlier[e]
            if not taken[d] and not claimed[k]:
                taken[d] = claimed[k] = 1
                root[d], sightings[d] = root[k], sightings[k] + 1
        roots, fresh = np.array(root), np.frombuffer(taken, np.uint8) == 0
        fresh[: len(old)] = False
        number = np.concatenate([np.array([t["id"] for t in old], np.int64), self.made + np.cumsum(fresh[len(old) :])])
        track, self.made = number[roots], self.made + int(fresh.sum())
        heads = np.flatnonzero((np.frombuffer(claimed, np.uint8) == 0) & (seen[-1] - seen <= MISSED))
        names = list(places)
        self.tracks = sorted(
            ({"id": int(track[i]), "label": names[code[i]], "box": tuple(box[:, i].tolist()), "score": old[i]["score"] if i < len(old) else float(score[i - len(old)]), "seen": int(seen[i]), "sightings": sightings[i]} for i in heads),
            key=lambda t: t["id"],
        )
        return track[len(old) :], np.array(sightings[len(old) :], np.int64)

    @staticmethod
    def alike(seen: np.ndarray, code: np.ndarray, box: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a detection and one of its label no more than ``MISSED`` + 1 ticks before it whose boxes overlap enough, and their overlap; the first ``old`` are no detections."""
        order = np.lexsort((seen, code))
        first, span = seen.min(), int(seen.max() - seen.min()) + 1
        at = code[order] * span + (seen[order] - first)
        since = code[order] * span + np.maximum(seen[order] - first - (MISSED + 1), 0)
        begin, end = np.searchsorted(at, since), np.searchsorted(at, at)
        count = np.where(order < old, 0, end - begin)
        total = np.concatenate([[0], np.cumsum(count)])
        l, t, r, b = (x[order] for x in box)
        area = (r - l) * (b - t)
        found = []
        a = 0
        while a < len(order):
            z = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(a, z), count[a:z])
            y = np.arange(total[a], total[z]) - np.repeat(total[a:z] - begin[a:z], count[a:z])
            # boxes that don't meet have no overlap, and most don't
            meet = (l[y] < r[x]) & (l[x] < r[y])
            x, y = x[meet], y[meet]
            meet = (t[y] < b[x]) & (t[x] < b[y])
            x, y = x[meet], y[meet]
            common = (np.minimum(r[y], r[x]) - np.maximum(l[y], l[x])) * (np.minimum(b[y], b[x]) - np.maximum(t[y], t[x]))
            union = area[y] + area[x] - common
            with np.errstate(all="ignore"):
                s = np.where(union > 0, common / union, 0.0)
            good = s >= OVERLAP
            found.append((order[x[good]], order[y[good]], s[good]))
            a = z
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


OUT = "camera long, stretch long, tick long, det int, track long, sightings long"


def tracked(detections: DataFrame, numbered: bool = False) -> DataFrame:
    """``camera``, ``tick``, ``det`` with the ``track`` of each detection and its ``sightings``.

    A camera's frames are taken in order, a few at a time, and only its live tracks are kept in memory.  If ticks are ``numbered`` frames,
    stretches more than ``MISSED`` ticks apart share no track: they are followed in different tasks, and tracks are numbered on.
    """
    key = ["camera", "stretch"]
    if numbered:
        w = Window.partitionBy("camera").orderBy("tick")
        ticks = detections.select("camera", "tick").distinct()
        apart = F.when(F.col("tick") - F.lag("tick").over(w) > MISSED + 1, 1).otherwise(0)
        ticks = ticks.withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(w)).drop("apart")
        detections = detections.join(ticks, ["camera", "tick"])
    else:
        detections = detections.withColumn("stretch", F.lit(0).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker, frame = None, Tracker(), []
        dets: list = []

        def close() -> list[tuple]:
            found = tracker.update(frame, now[2] if numbered else None)
            return [(*now, det, *x) for det, x in zip(dets, found, strict=True)]

        for pdf in batches:
            rows: list[tuple] = []
            # plain lists, as a row of pandas costs more than following its track
            for camera, stretch, tick, det, label, score, *box in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True):
                at = (camera, stretch, tick)
                if at != now:
                    rows += close() if frame else []
                    tracker = tracker if now is not None and at[:2] == now[:2] else Tracker()
                    now, frame, dets = at, [], []
                frame.append({"label": label, "score": score, "box": tuple(box)})
                dets.append(det)
            yield pd.DataFrame(rows, columns=[*key, "tick", "det", "track", "sightings"])
        if frame:
            yield pd.DataFrame(close(), columns=[*key, "tick", "det", "track", "sightings"])

    flat = detections.select(*key, "tick", "det", "label", "score", *[F.col(f"box.{c}").alias(c) for c in "ltrb"])
    out = flat.repartition(*key).sortWithinPartitions(*key, "tick", "det", "label", "score").mapInPandas(run, OUT)
    if not numbered:
        return out.drop("stretch")
    out = out.persist(StorageLevel.DISK_ONLY)  # read twice; a lost part is followed again
    made = out.groupBy(*key).agg(F.max("track").alias("made"))
    first = made.withColumn("first", F.coalesce(F.sum("made").over(Window.partitionBy("camera").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(first.drop("made"), key).withColumn("track", F.col("track") + F.col("first"))
    return out.select("camera", "tick", "det", "track", "sightings")


def confirmed(tracks: Iterator[dict], sightings: int = 3) -> list[dict]:
    return [t for t in tracks if t["sightings"] >= sightings]
