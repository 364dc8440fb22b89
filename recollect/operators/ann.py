"""A trained index for approximate search (VEC11, VEC12, EVL8): inverted lists of a coarse quantiser, product-quantised residuals, exact rescoring.

``train`` fits the quantiser on a bounded sample: spherical k-means gives the centre of each list, and what is left of the sample's vectors
after their centres gives, for each part of the components, a book of ``BOOK`` codewords.  ``build`` writes all points, each in the list of
its nearest centre and with one byte for each part, in files partitioned by list.  Lists of very many points are split over files by the
writer's rebalancing, and ``append`` adds points under the same centres.

A query looks into the lists whose centres are nearest.  These are few, so the scan names them and reads no others.  ``search`` scores
the bytes there by tables (the query's products with all codewords, which by linearity serve all lists), keeps the best candidates, and only
these candidates' vectors are scored exactly.  ``search_lists`` scores all vectors of the lists exactly, by an equi-join on the list.

Vectors have their direction alone counted (cosine).  A vector of zeros has none: it is in the first list and scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vectors as V
from .pairs import Asked, blocks
from .pairs import nearest as nearest_of
from .search import DIGITS, top

#: Points that the quantiser is fitted on, rounds of fitting, lists at most.
SAMPLE, ROUNDS, LISTS = 50_000, 3, 4096
#: Parts of a vector, and codewords of a part's book.
PARTS, BOOK = 16, 256
#: Queries that are answered in one pass over the lists.
BLOCK = 1000
#: The same where no tables of products are needed.
LIST_BLOCK = 20_000


def unit(m: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((m * m).sum(1))
    return m / np.where(lengths > 0, lengths, 1.0)[:, None]


def nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres, by products of nine digits."""
    return np.round(m @ centres.T, 9).argmax(1)


def directions(points: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of spherical k-means from evenly spaced points; a list that has lost all its points keeps its centre."""
    step = max(len(points) // lists, 1)
    centres = points[::step][:lists].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.stack([np.bincount(own, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        held = np.bincount(own, minlength=len(centres)) > 0
        centres[held] = unit(sums[held])
    return centres


def book_of(parts: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """Codewords by plain k-means; fewer points than codewords are their own."""
    words = parts[:: max(len(parts) // size, 1)][:size].copy()
    for _ in range(rounds):
        own = ((words * words).sum(1) / 2 - parts @ words.T).argmin(1)
        held = np.bincount(own, minlength=len(words))
        sums = np.stack([np.bincount(own, parts[:, d], len(words)) for d in range(parts.shape[1])], 1)
        words[held > 0] = sums[held > 0] / held[held > 0, None]
    return words


@dataclass
class Quantiser:
    """``centres`` (a row for each list) and ``books`` (for each part its codewords)."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([0, *(b.shape[1] for b in self.books)]).tolist()

    def codes(self, m: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = m - self.centres[lists]
        each = [((b * b).sum(1) / 2 - rest[:, x:y] @ b.T).argmin(1) for b, x, y in zip(self.books, self.cuts, self.cuts[1:], strict=False)]
        return np.stack(each, 1).astype(np.uint8) if each else np.zeros((len(m), 0), np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query the products with all codewords: queries x parts x codewords."""
        out = np.zeros((len(q), len(self.books), BOOK))
        for j, (b, x, y) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            out[:, j, : len(b)] = q[:, x:y] @ b.T
        return out

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each query, the nearest first."""
        return np.argsort(-np.round(q @ self.centres.T, 9), axis=1, kind="stable")[:, :n]


def matrix(values: pa.Array, size: int) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return unit(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def default_lists(n: int) -> int:
    return max(1, min(LISTS, round(n**0.5)))


def train(points: DataFrame, vector: str = "clip", lists: int | None = None, sample: int = SAMPLE, parts: int = PARTS, rounds: int = ROUNDS) -> Quantiser:
    """Fit on at most ``sample`` points: on all if they are no more, on those of the least hashed ids otherwise."""
    usable = points.filter(F.col(vector).isNotNull()).select("id", F.col(vector).cast("array<double>").alias("v"))
    n = usable.count()
    chosen = usable if n <= sample else usable.orderBy(F.xxhash64("id"), "id").limit(sample)
    got = chosen.orderBy("id").toArrow()["v"]
    if not len(got):
        return Quantiser(np.zeros((1, 0)), [])
    size = len(got[0])
    m = matrix(got, size)
    centres = directions(m, min(lists or default_lists(n), len(m)), rounds)
    rest = m - centres[nearest(m, centres)]
    edges = np.linspace(0, size, min(parts, size) + 1).astype(int)
    return Quantiser(centres, [book_of(rest[:, x:y], BOOK, rounds) for x, y in zip(edges, edges[1:], strict=False)])


class Index:
    """A folder with the ``points`` (their columns, ``list`` and ``code``) and the ``model``."""

    def __init__(self, spark: SparkSession, path: str, vector: str = "clip"):
        self.spark, self.path, self.vector = spark, path.rstrip("/"), vector

    @classmethod
    def build(cls, points: DataFrame, path: str, vector: str = "clip", lists: int | None = None, **fitting) -> Index:
        index = cls(points.sparkSession, path, vector)
        q = train(points, vector, lists, **fitting)
        rows = [("centre", k, c.tolist()) for k, c in enumerate(q.centres)] + [(f"part {j}", k, w.tolist()) for j, b in enumerate(q.books) for k, w in enumerate(b)]
        index.spark.createDataFrame(rows, "kind string, number int, v array<double>").coalesce(1).write.parquet(f"{index.path}/model")
        index._rows(points, q).limit(0).write.parquet(f"{index.path}/schema")  # an empty table keeps its columns
        index.append(points)
        return index

    def quantiser(self) -> Quantiser:
        """The model: as many rows as there are lists and codewords."""
        rows = self.spark.read.parquet(f"{self.path}/model").orderBy("kind", "number").collect()
        of = lambda kind: np.array([r["v"] for r in rows if r["kind"] == kind])
        parts = len({r["kind"] for r in rows}) - 1
        return Quantiser(of("centre"), [of(f"part {j}") for j in range(parts)])

    def _rows(self, points: DataFrame, q: Quantiser) -> DataFrame:
        """Points with ``code`` and ``list``."""
        vector, size = self.vector, q.centres.shape[1]
        rows = points.filter(F.col(vector).isNotNull() & (F.size(vector) == size)).withColumn(vector, F.col(vector).cast("array<float>"))
        kind = StructType([*rows.schema.fields]).add("code", "binary").add("list", "integer")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    m = matrix(batch.column(vector), size)
                    own = nearest(m, q.centres)
                    codes = [c.tobytes() for c in q.codes(m, own)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(own, pa.int32())], names=kind.names)

        return rows.mapInArrow(run, kind)

    def append(self, points: DataFrame) -> None:
        """Add points under the lists there are."""
        out = self._rows(points, self.quantiser()).hint("rebalance", "list")
        out.write.mode("append").partitionBy("list").parquet(f"{self.path}/points")

    def points(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/points")

    def _blocks(self, queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
        """Queries (``qid``, ``q``) in blocks of a bounded number."""
        for part in blocks(queries, BLOCK):
            got = part.select("qid", F.col("q").cast("array<double>").alias("q")).toArrow()
            if got.num_rows:
                yield got["qid"].to_pylist(), matrix(got["q"], len(got["q"][0]))

    def _joined(self, parts: list[DataFrame]) -> DataFrame:
        empty = self.spark.createDataFrame([], "qid long, id long, score double, rank int")
        return reduce(DataFrame.unionByName, parts) if parts else empty

    def search_lists(self, queries: DataFrame, k: int = 5, probes: int = 8, where: Column | None = None) -> DataFrame:
        """``qid``, ``id``, ``score``, ``rank``: the exact best of the ``probes`` nearest lists."""
        model = self.quantiser()
        rows = self.points() if where is None else self.points().filter(where)

        def looks(asked: Asked):
            if not len(asked.slot) or probes >= len(model.centres):
                return lambda _: None
            looked = model.probes(asked.q.unit, probes)
            queries, lists = np.repeat(np.arange(len(looked), dtype=np.int32), looked.shape[1]), looked.ravel()
            order = np.argsort(lists, kind="stable")
            edges = np.searchsorted(lists[order], np.arange(len(model.centres) + 1))
            own = queries[order]
            return lambda c: own[edges[c] : edges[c + 1]]

        wanted: set[int] = set()
        for _, q in self._blocks(queries) if probes < len(model.centres) else ():
            wanted.update(np.unique(model.probes(q, probes)).tolist())
        rows = rows if probes >= len(model.centres) else rows.filter(F.col("list").isin(sorted(wanted)))
        asked = queries.select("qid", F.col("q").cast("array<double>").alias("q"))
        found = nearest_of(rows.select(F.col("id").cast("long").alias("id"), "list", self.vector), asked, k, self.vector, group="list", looks=looks, size=LIST_BLOCK)
        return top(found, k).select("qid", "id", "score", "rank")

    def candidates(self, qids: list, q: np.ndarray, model: Quantiser, probes: int, most: int, where: Column | None = None) -> DataFrame:
        """``qid``, ``list``, ``id`` and ``approx`` of the ``most`` best points of each query by the tables."""
        looked = model.probes(q, probes)
        of_list: dict[int, np.ndarray] = {c: np.flatnonzero((looked == c).any(1)) for c in np.unique(looked).tolist()}
        tables, base, parts = model.tables(q), q @ model.centres.T, len(model.books)
        kind = StructType().add("query", "integer").add("list", "integer").add("id", "long").add("approx", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, ...]] = {}
            for batch in batches:
                own = batch.column("list").to_numpy()
                ids = batch.column("id").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                for c in np.unique(own).tolist():
                    rows = np.flatnonzero(own == c)
                    some = of_list[c]
                    approx = base[some, c][:, None] + sum(tables[some, j][:, codes[rows, j]] for j in range(parts))
                    for n, one in enumerate(some.tolist()):
                        old = best.get(one, (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)))
                        all_ = (np.concatenate([old[0], approx[n]]), np.concatenate([old[1], ids[rows]]), np.concatenate([old[2], np.full(len(rows), c, np.int32)]))
                        first = np.lexsort((all_[1], -all_[0]))[:most]
                        best[one] = tuple(x[first] for x in all_)
            for one, (approx, ids, lists) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), one, np.int32)), pa.array(lists), pa.array(ids), pa.array(approx)], names=kind.names)

        rows = self.points() if where is None else self.points().filter(where)
        found = rows.filter(F.col("list").isin(list(of_list))).select("list", F.col("id").cast("long").alias("id"), "code").mapInArrow(run, kind)
        names = self.spark.createDataFrame(list(enumerate(qids)), "query int, qid long")
        found = found.join(F.broadcast(names), "query").drop("query")
        return top(found, most, F.desc("approx")).drop("rank")

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, rescored: int = 64, where: Column | None = None) -> DataFrame:
        """``qid``, ``id``, ``score``, ``rank``: ``rescored`` candidates of the ``probes`` nearest lists by their bytes, the best of them exactly."""
        model, parts = self.quantiser(), []
        for qids, q in self._blocks(queries):
            found = self.candidates(qids, q, model, probes, max(k, rescored), where)
            lists = np.unique(model.probes(q, probes)).tolist()
            vectors = self.spark.createDataFrame([(i, v.tolist()) for i, v in zip(qids, q, strict=True)], "qid long, q array<double>")
            own = self.points().filter(F.col("list").isin(lists)).select("list", F.col("id").cast("long").alias("id"), self.vector)
            near = own.join(F.broadcast(found.drop("approx")), ["list", "id"]).join(F.broadcast(vectors), "qid")  # BLOCK x rescored rows
            parts.append(top(near.select("qid", "id", F.round(V.cosine(F.col(self.vector), F.col("q")), DIGITS).alias("score")), k))
        return self._joined(parts)
