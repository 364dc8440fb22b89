"""Operator 13: hard negatives by a Voronoi-partitioned distributed nearest-neighbour join.

An anchor's positives are the rows of its label with the highest scores, its negatives for each positive the highest rows of other labels
that score between ``WINDOW`` of the positive and the positive itself.  A score is the integer inner product of the quantised vectors.

Inner products become angles: a row x gets one more coordinate, sqrt(M^2 - |x|^2) with M the greatest norm, so that all rows lie on one
sphere; an anchor a is stretched onto it with a last coordinate of 0.  Then score(a, x) = |a| M cos(angle), and angles keep the triangle
inequality.  Pivots cut the sphere into Voronoi cells, anchors are grouped by cell, and each group is split into blocks of a bounded
size.  With r = angle(a, p) for the anchors of a cell with pivot p, and t the largest angle at which a row can still be wanted by a,
a row x at angle(x, p) outside of [min(r - t), max(r + t)] serves no anchor of the group and isn't sent there.

1. Each anchor meets the rows of its own cell, which gives a lower bound on its last positive, hence t.
2. Rows within the bounds are sent to the groups they might serve, for the positives.
3. The positives give the lowest score that a negative may have, hence another t; rows are sent again, for the negatives.

Rows are sent to a group in parts of a bounded size (by a hash, so a vector or label of very many rows is spread), each met by each
block of its anchors.  A part keeps the best few for each anchor and cap, and these meet by anchor.  Pivots are the means of a bounded
sample and their number is bounded, so only they and their bounds are sent to all tasks.  On vectors without structure no bound prunes and
each row goes to each group; the results don't depend on it.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; missing components of shorter
vectors are 0; a null id is no anchor's unless the caller says so, and sorts after all others; repeated rows are rows each, so an anchor's copy
is one of its other rows; rows that tie in score and id are interchangeable; an anchor without positives or a positive without
negatives gives no rows; scores beyond 64 bits become the greatest or least; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import written

#: Positives of an anchor, negatives of a positive, and the least part of the positive's score that a negative has (in hundredths).
POSITIVES, NEGATIVES, WINDOW = 5, 5, 80
#: Rows that pivots are fitted on, pivots at most, rounds of fitting.
SAMPLE, PIVOTS, ROUNDS = 4096, 128, 5
#: Anchors of a block and rows of a part at most, on average.
ANCHORS, ROWS = 512, 8192
#: Angles are given so much room for rounding.
SLACK = 1e-5
QUANTUM = 256.0

LEAST = -(1 << 63)


@dataclass
class Sphere:
    """Pivots (unit vectors with the added coordinate, one a row), the greatest norm, the number of components."""

    pivots: np.ndarray
    greatest: float
    size: int

    def rows(self, v: np.ndarray) -> np.ndarray:
        """Angles to all pivots, of rows with their added coordinate."""
        square = np.minimum((v * v).sum(1) / self.greatest**2, 1.0) if self.greatest else np.ones(len(v))
        scaled = v / self.greatest if self.greatest else v
        return self.angles(np.concatenate([scaled, np.sqrt(1 - square)[:, None]], 1))

    def anchors(self, v: np.ndarray) -> np.ndarray:
        """Angles to all pivots, of anchors stretched onto the sphere (pi for an anchor of zeros, which has no direction)."""
        norm = np.sqrt((v * v).sum(1))
        found = self.angles(np.concatenate([v / np.where(norm, norm, 1.0)[:, None], np.zeros((len(v), 1))], 1))
        found[norm == 0] = np.pi
        return found

    def angles(self, points: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(points @ self.pivots.T, -1, 1))


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Quantised vectors as rows of a matrix, zeros where components are missing."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.asarray(vectors.value_lengths())
    values = np.floor(QUANTUM * vectors.flatten().to_numpy().astype(np.float64))
    if len(lengths) and (lengths == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    for k, part in enumerate(np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []):
        out[k, : len(part)] = part
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: in doubles where these are exact, otherwise in Python's integers."""
    most = max(float(np.abs(a).max(initial=0)), 1.0) * max(float(np.abs(b).max(initial=0)), 1.0) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LEAST, -LEAST - 1).astype(np.int64)


def usable(df: DataFrame, anchor: Column, vec_id: str, vector: str, label: str) -> DataFrame:
    """A written table of the rows that take part: ``row`` (a number of its own), ``id``, ``label``, ``anchor``, ``v``."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & real)
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("v"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def fitted(rows: DataFrame, anchors: int) -> Sphere:
    """The sphere of the rows, with pivots for so many anchors fitted on a bounded sample."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(QUANTUM * x.cast("double")).cast("double") * F.floor(QUANTUM * x.cast("double")).cast("double")))
    size, greatest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    greatest *= 1 + 1e-12
    sphere = Sphere(np.zeros((1, size + 1)), greatest, size)
    sphere.pivots[0, -1] = 1.0
    some = matrix(rows.orderBy(F.xxhash64("v", "row")).limit(SAMPLE).select("v").toArrow()["v"], size)
    if not len(some) or not greatest:
        return sphere
    points = np.concatenate([some / greatest, np.sqrt(np.maximum(1 - (some * some).sum(1) / greatest**2, 0))[:, None]], 1)
    k = int(min(PIVOTS, len(points), max(1, round(anchors**0.5 / 2))))
    pivots = points[:: len(points) // k][:k].copy()
    for _ in range(ROUNDS):
        near = (points @ pivots.T).argmax(1)
        for j in range(k):
            total = points[near == j].sum(0)
            if np.linalg.norm(total) > 0:
                pivots[j] = total / np.linalg.norm(total)
    sphere.pivots = pivots
    return sphere


PLACED = StructType().add("cell", "integer").add("angle", "double").add("norm", "double").add("row", "long").add("id", "long")


def placed(anchors: DataFrame, sphere: Sphere) -> DataFrame:
    """A written table of the anchors with their cell, angle to its pivot, norm, and block within the cell."""
    kind = StructType([*PLACED, anchors.schema["label"], anchors.schema["v"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), sphere.size)
            angles = sphere.anchors(v)
            cell = angles.argmin(1)
            columns = [pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(v)), cell]), pa.array(np.sqrt((v * v).sum(1)))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(n) for n in kind.names[3:])], names=kind.names)

    found = written(anchors.select(*kind.names[3:]).mapInArrow(run, kind), "placed")
    counts = {r["cell"]: r["n"] for r in found.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot at most
    blocks = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // ANCHORS))]) if counts else None
    block = F.pmod(F.xxhash64("row"), blocks[F.col("cell")]).cast("int") if counts else F.lit(0)
    return found.withColumn("block", block)


def sent_to(rows: DataFrame, sphere: Sphere, blocks: dict[int, int], low: np.ndarray | None, high: np.ndarray | None) -> DataFrame:
    """Rows with ``cell`` for each group that they might serve: within the bounds on angles, or without bounds that of their own cell."""
    kind = StructType().add("cell", "integer")
    kind = StructType([*kind, *rows.select("row", "id", "label", "v").schema])
    live = np.array([bool(blocks.get(c)) for c in range(len(sphere.pivots))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = sphere.rows(matrix(batch.column("v"), sphere.size))
            if low is None or high is None:
                wanted = np.zeros(angles.shape, bool)
                wanted[np.arange(len(angles)), angles.argmin(1)] = True
            else:
                wanted = (angles >= low - SLACK) & (angles <= high + SLACK)
            for c in np.flatnonzero(live):
                some = np.flatnonzero(wanted[:, c])
                if len(some):
                    part = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, np.int32)), *(part.column(n) for n in kind.names[1:])], names=kind.names)

    return rows.select("row", "id", "label", "v").mapInArrow(run, kind)


FOUND = StructType().add("anchor", "long").add("cap", "integer").add("row", "long").add("id", "long").add("score", "long")


def met(anchors: DataFrame, rows: DataFrame, blocks: dict[int, int], parts: int, sphere: Sphere, best: Callable) -> DataFrame:
    """What ``best`` finds of each anchor and part of the rows that are sent to its group: ``anchor``, ``cap``, ``row``, ``id``, ``score``."""
    most = max(blocks.values(), default=1)
    split = F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)]) if blocks else F.create_map(F.lit(0), F.lit(1))
    each = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int"))
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0), split[F.col("cell")] - 1))) if most > 1 else each.withColumn("block", F.lit(0))
    groups = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["cell", "block", "part"]

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            none = np.asarray(right["id"].combine_chunks().is_null())
            order = np.lexsort((right["row"].to_numpy(), right["id"].combine_chunks().fill_null(0).to_numpy(), none))
            right = right.take(pa.array(order))  # by id, so that a stable sort by score settles ties
            scores = products(matrix(left["v"], sphere.size), matrix(right["v"], sphere.size))
            labels = pa.concat_arrays([left["label"].combine_chunks(), right["label"].combine_chunks()]).dictionary_encode().indices.to_numpy()
            mine, theirs = labels[: left.num_rows], labels[left.num_rows :]
            own, other = left["row"].to_numpy(), right["row"].to_numpy()
            for k in range(left.num_rows):
                for cap, places in best(left, k, scores[k], (theirs == mine[k]), other != own[k]):
                    out.append((np.full(len(places), own[k]), np.full(len(places), cap, np.int32), places, scores[k][places]))
        if not out:
            return pa.table({f.name: pa.array([], pa.int32() if f.name == "cap" else pa.int64()) for f in FOUND})
        anchor, cap, places, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"anchor": anchor, "cap": cap, "row": other[places], "id": right["id"].combine_chunks().take(pa.array(places)), "score": score})

    return groups.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(local, FOUND)


def top(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest allowed scores, the earlier of equal ones first."""
    places = np.flatnonzero(allowed)
    if len(places) > k:
        least = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= least]
    return places[np.argsort(-scores[places], kind="stable")][:k]


def merged(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "cap").orderBy(*order))).filter(F.col("rank") <= k)


def bounds(anchors: DataFrame, least: DataFrame, sphere: Sphere) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest angle to each pivot at which a row may serve its anchors, given the ``least`` score of each ``anchor``.

    Where that is null, all rows may serve; anchors that ``least`` lacks need none.
    """
    reach = F.when(F.col("least").isNull() | (F.col("norm") == 0), F.lit(np.pi))
    reach = reach.otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") / (F.col("norm") * F.lit(sphere.greatest or 1.0))))))
    each = anchors.join(least, anchors["row"] == least["anchor"]).select("cell", "angle", reach.alias("reach"))
    found = each.groupBy("cell").agg(F.min(F.col("angle") - F.col("reach")).alias("low"), F.max(F.col("angle") + F.col("reach")).alias("high")).collect()
    low, high = np.full(len(sphere.pivots), np.inf), np.full(len(sphere.pivots), -np.inf)
    for r in found:
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    return low, high


def mine(
    df: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, window: int = WINDOW
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score`` for the rows where ``anchor`` holds."""
    rows = usable(df, anchor, vec_id, vector, label)
    n, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    sphere = fitted(rows, n_anchors)
    anchors = placed(rows.filter("anchor"), sphere)
    blocks = {r["cell"]: r["n"] + 1 for r in anchors.groupBy("cell").agg(F.max("block").alias("n")).collect()}
    parts = max(1, -(-n // ROWS))

    def same(left: pa.Table, k: int, scores: np.ndarray, same: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, top(scores, same & others, positives)

    def lower(left: pa.Table, k: int, scores: np.ndarray, same: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for cap in left["caps"][k].as_py():
            # in Python's integers, as a hundred times a score may be beyond 64 bits
            yield cap["rank"], top(scores, ~same & (scores >= -(-window * cap["score"] // 100)) & (scores <= cap["score"]), negatives)

    # a lower bound on the last positive, from the rows of each anchor's own cell
    met_first = merged(met(anchors, sent_to(rows, sphere, blocks, None, None), blocks, parts, sphere, same), positives)
    known = met_first.groupBy("anchor").agg(F.min("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") >= positives)
    known = anchors.select(F.col("row").alias("anchor")).join(known, "anchor", "left").select("anchor", F.col("score").alias("least"))
    low, high = bounds(anchors, written(known, "known"), sphere)
    # the positives
    found = merged(met(anchors, sent_to(rows, sphere, blocks, low, high), blocks, parts, sphere, same), positives)
    found = written(found.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the negatives: a positive below 0 has none, as the window is empty
    caps = found.filter("positive_score >= 0").groupBy("anchor").agg(F.collect_list(F.struct("rank", F.col("positive_score").alias("score"))).alias("caps"), F.min("positive_score").alias("last"))
    caps = written(caps, "caps")
    low, high = bounds(anchors, caps.select("anchor", (F.col("last") * F.lit(window / 100)).alias("least")), sphere)
    asked = anchors.join(caps.select("anchor", "caps"), anchors["row"] == F.col("anchor")).drop("anchor")
    negative = merged(met(asked, sent_to(rows, sphere, blocks, low, high), blocks, parts, sphere, lower), negatives)
    negative = negative.select("anchor", F.col("cap").alias("of"), F.col("rank").alias("place"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(negative, (found["anchor"] == negative["anchor"]) & (found["rank"] == F.col("of"))).select(found["anchor"], "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score")
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return out.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
