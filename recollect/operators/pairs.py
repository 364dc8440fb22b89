"""Points against queries by matrix products, for searches that must look at all pairs.

Queries go to the tasks in blocks, and the points are dealt over the tasks; a task multiplies its points' unit vectors by the queries' and
looks closer only at products within ``NEAR`` of what it keeps.  Those are computed again as ``functions.vectors`` has them (double precision, from
left to right), rounded to ``DIGITS`` digits and then ranked, so results are those of the column expressions.  A task keeps ``k`` points of a query.

Vectors that are null, have null components or another length than the query's score 0, as do vectors of zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DIGITS = 6
#: Products this near to each other may round to the same score.
NEAR = 1.1 * 10**-DIGITS
#: Points and queries that are multiplied at once, pairs that are computed again at once, and rows of a batch of pairs.
ROWS, COLUMNS, AGAIN, PAIRS = 4096, 1024, 1 << 16, 1 << 17
#: Pairs that come out in order of their cosine.
SORTED = 1 << 22
#: Norms up to which squared distances are taken from products.
LONG = 10.0
#: Tasks for each core: a task gives up to k points for each query, so more of them shuffle more.
TASKS = 2
#: Queries are sent to all tasks up to this number; more are searched in blocks of it.
SENT_QUERIES = 20_000


def blocks(queries: DataFrame, size: int | None = None) -> list[DataFrame]:
    """A set of queries in parts of about ``size``, so that what is sent to all tasks is bounded whatever their number."""
    n = -(-queries.count() // (size or SENT_QUERIES))
    return [queries] if n <= 1 else [queries.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) for k in range(n)]


def matrix(column: pa.Array, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded by zeros, and their lengths; those that have no cosine are zeros of the length ``other``."""
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    if not column.null_count and len(lengths) and (lengths == lengths[0]).all():
        flat = column.flatten()
        if not flat.null_count:
            return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1), lengths
    m = np.zeros((len(lengths), int(lengths.max(initial=0))))
    for i, v in enumerate(column.to_pylist()):
        if v is None or any(x is None for x in v):
            lengths[i] = other
        else:
            m[i, : len(v)] = v
    return m, lengths


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from left to right."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def rounded(x: np.ndarray, digits: int = DIGITS, exact: Callable[[tuple], np.ndarray] | None = None) -> np.ndarray:
    """Rounded half up as Spark rounds, by decimal digits.  ``exact`` gives the values of the few places that nearly are at a half."""
    scale = 10.0**digits
    y = x * scale
    low = np.floor(y)
    out = (low + (y - low >= 0.5)) / scale + 0.0
    places = np.nonzero(np.abs(y - low - 0.5) < 1e-6)
    if len(places[0]):
        values = x[places] if exact is None else exact(places)
        unit = Decimal(1).scaleb(-digits)
        out[places] = [float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) + 0.0 for v in values]
    return out


class Side:
    """Vectors of one side: as they are (``m``), their lengths, norms, and unit vectors.

    Unit vectors of norms beyond what doubles hold are not a number: such pairs are always looked at closer.
    """

    def __init__(self, column: pa.Array, other: int):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.m, self.size = matrix(column, other)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(dots(self.m, self.m))
            fair = (self.norm > 1e-140) & (self.norm < 1e140)
            self.unit = self.m / np.where(self.norm > 0, self.norm, 1.0)[:, None]
            self.unit[~fair & (self.norm != 0)] = np.nan

    def some(self, rows: slice) -> Side:
        part = copy(self)
        part.m, part.size, part.norm, part.unit = self.m[rows], self.size[rows], self.norm[rows], self.unit[rows]
        return part

    def padded(self, size: int) -> Side:
        if self.m.shape[1] < size:
            more = ((0, 0), (0, size - self.m.shape[1]))
            self.m, self.unit = np.pad(self.m, more), np.pad(self.unit, more)
        return self


def cosines(p: Side, i: np.ndarray, q: Side, j: np.ndarray) -> np.ndarray:
    """The cosines of pairs of rows as ``functions.vectors.cosine`` has them."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for a in range(0, len(i), AGAIN):
            x, y = i[a : a + AGAIN], j[a : a + AGAIN]
            lengths = p.norm[x] * q.norm[y]
            value = np.where((lengths > 0) | np.isnan(lengths), dots(p.m[x], q.m[y]) / lengths, 0.0)
            out[a : a + AGAIN] = np.where(p.size[x] == q.size[y], value, 0.0)
    return out


def products(p: Side, rows: np.ndarray | slice, q: Side, columns: np.ndarray | slice) -> np.ndarray:
    m = p.unit[rows] @ q.unit[columns].T
    sizes = p.size[rows], q.size[columns]
    if len(np.unique(np.concatenate(sizes))) > 1:
        m[sizes[0][:, None] != sizes[1][None, :]] = 0.0
    return m


@dataclass
class Asked:
    """A block of queries: ``qids`` are the different ones, ``slot`` the place of each row's there."""

    qids: pa.Array
    slot: np.ndarray
    table: pa.Table
    q: Side

    @classmethod
    def of(cls, queries: DataFrame) -> Asked:
        table = queries.toArrow().combine_chunks()
        ids = table["qid"].combine_chunks()
        places: dict = {}
        slot = np.array([places.setdefault(v, len(places)) for v in ids.to_pylist()], np.int64)
        return cls(pa.array(list(places), ids.type), slot, table.drop_columns(["q"]), Side(table["q"], -2))


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches of any size as tables of about ``rows``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            held.append(batch.slice(a, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Best:
    """The ``k`` best points of each query in one task: greatest ``key`` first, then least id.  ``rows`` are the points that are held."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.key, self.score = np.full((queries, k), -np.inf), np.zeros((queries, k))
        self.id: np.ndarray = np.zeros((queries, k), np.int64)
        self.row = np.full((queries, k), -1, np.int64)
        self.rows: list[pa.Table] = []
        self.held, self.bound = 0, 1 << 18

    def least(self) -> np.ndarray:
        """What a key must reach for each query."""
        return self.key[:, -1]

    def beats(self, ids: np.ndarray, slot: np.ndarray, point: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which pairs may be among the best: of numbered points an equal one needs a lesser id."""
        least = self.least()[slot]
        if ids.dtype == object:
            return key >= least
        return (key > least) | ((key == least) & (ids[point] < self.id[slot, -1]))

    def add(self, block: pa.Table, ids: np.ndarray, slot: np.ndarray, point: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        """Pairs of queries and rows of ``block``."""
        good = self.beats(ids, slot, point, key)
        if ids.dtype != self.id.dtype:
            self.id = self.id.astype(ids.dtype)
        slot, point, key, score = slot[good], point[good], key[good], score[good]
        if not len(slot):
            return
        some, own = np.unique(slot, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(some)), self.k), own])
        used, place = np.unique(point, return_inverse=True)
        fields = [(self.key, key), (self.score, score), (self.id, ids[point]), (self.row, self.held + place)]
        joined = [np.concatenate([old[some].ravel(), new]) for old, new in fields]
        names = joined[2] if joined[2].dtype != object else np.unique(joined[2].astype(str), return_inverse=True)[1]
        real = joined[3] >= 0
        order = np.lexsort((names, ~real, -joined[0], at))
        begins = np.searchsorted(at[order], np.arange(len(some)))
        rank = np.arange(len(order)) - begins[at[order]]
        kept = order[rank < self.k]  # k rows of each, as its old ones are k
        for (old, _), new in zip(fields, joined, strict=True):
            old[some] = new[kept].reshape(len(some), self.k)
        self.rows.append(block.take(pa.array(used)))
        self.held += len(used)
        if self.held > self.bound:
            self.compact()

    def compact(self) -> None:
        live, place = np.unique(self.row, return_inverse=True)
        skip = int(len(live) > 0 and live[0] < 0)
        self.rows = [pa.concat_tables(self.rows).combine_chunks().take(pa.array(live[skip:]))]
        self.row = place.reshape(self.row.shape) - skip
        self.held = len(live) - skip
        self.bound = 2 * self.held + (1 << 18)

    def batches(self, qids: pa.Array, names: list[str], extra: Callable[[np.ndarray, np.ndarray], dict]) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self.compact()
        rows = self.rows[0].combine_chunks()
        step = max(1, PAIRS // 8 // self.k)
        for a in range(0, len(self.key), step):
            slot, place = np.nonzero(self.row[a : a + step] >= 0)
            if len(slot):
                slot = slot + a
                own = rows.take(pa.array(self.row[slot, place])).combine_chunks()
                columns = {n: own[n] for n in own.column_names} | {"qid": qids.take(pa.array(slot))} | extra(slot, place)
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (columns[n] for n in names)], names=names)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.fill_null(np.iinfo(np.int64).min if pa.types.is_int64(column.type) else 0).to_numpy().astype(np.int64)
    return np.array(["" if v is None else str(v) for v in column.to_pylist()], object)


def dealt(points: DataFrame) -> DataFrame:
    """Points over twice as many tasks as there are cores, however few files they come from."""
    return points.repartition(TASKS * points.sparkSession.sparkContext.defaultParallelism, "id")


def nearest(points: DataFrame, queries: DataFrame, k: int, vector: str = "clip", code: str | None = None, group: str | None = None, looks: Callable[[Asked], Callable[[int], np.ndarray | None]] | None = None, other: bool = False, size: int | None = None) -> DataFrame:
    """For each query the ``k`` best points of each task: their columns but ``vector``, ``qid`` and ``score``, rounded.

    Points are best by score, or by the bits in which ``code`` differs from the query's ``code`` (then ``apart`` tells how many).  With ``looks`` a query
    meets points of some groups only: it gives of a block of queries a function from the number in ``group`` to the queries' places (None: all).
    With ``other`` a point whose id is the query's doesn't count.
    """
    kept = [f for f in points.schema.fields if f.name not in (vector, code, group)]
    kind = StructType([*kept, queries.schema["qid"]]).add("score", "double")
    if code:
        kind = kind.add("apart", "integer")
    dealt_points = dealt(points)

    def of_block(asked: Asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        looked = looks(asked) if looks else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(asked.qids), k)
            qcode = ids_of(asked.table["code"]).view(np.uint64) if code else None
            qid = asked.table["qid"].to_numpy(zero_copy_only=False) if other else None
            for block in in_blocks(batches, ROWS):
                p, ids = Side(block[vector], -1), ids_of(block["id"])
                size = max(p.m.shape[1], asked.q.m.shape[1])
                p, q = p.padded(size), asked.q.padded(size)
                plain = block.select([f.name for f in kept])
                pcode = ids_of(block[code]).view(np.uint64) if code else None
                groups = block[group].to_numpy() if group else np.zeros(block.num_rows, np.int64)
                for g in np.unique(groups):
                    rows = np.flatnonzero(groups == g)
                    wanted = looked(int(g)) if looked else None
                    wanted = np.arange(len(asked.slot)) if wanted is None else wanted
                    for a in range(0, len(wanted), COLUMNS):
                        columns = wanted[a : a + COLUMNS]
                        m = -np.bitwise_count(pcode[rows, None] ^ qcode[None, columns]).astype(np.float32) if code else products(p, rows, q, columns)
                        slack = 0.0 if code else NEAR
                        if other:
                            m[ids[rows, None] == qid[None, columns]] = -np.inf
                        hit = ~(m < (best.least()[asked.slot[columns]] - slack)[None, :])
                        if hit.sum() > 4 * k * len(columns) and len(rows) > k:  # too many to be looked at: the best of the block are enough
                            edge = np.partition(np.where(np.isnan(m), np.inf, m), len(rows) - k, axis=0)[len(rows) - k]
                            hit &= ~(m < (edge - slack)[None, :])
                        if other:
                            hit &= m != -np.inf
                        i, j = np.nonzero(hit)
                        for b in range(0, len(i), 16 * AGAIN):
                            x, y = rows[i[b : b + 16 * AGAIN]], columns[j[b : b + 16 * AGAIN]]
                            key = m[i[b : b + 16 * AGAIN], j[b : b + 16 * AGAIN]].astype(np.float64) if code else None
                            if code:  # the least ids of equally many bits come first, before anything is scored
                                enough = best.beats(ids, asked.slot[y], x, key)
                                x, y, key = x[enough], y[enough], key[enough]
                            score = rounded(cosines(p, x, q, y))
                            best.add(plain, ids, asked.slot[y], x, key if code else np.where(np.isnan(score), np.inf, score), score)
            more = lambda slot, place: {"score": pa.array(best.score[slot, place])} | ({"apart": pa.array((-best.key[slot, place]).astype(np.int32))} if code else {})
            yield from best.batches(asked.qids, kind.names, more)

        return run

    return reduce(DataFrame.unionByName, [dealt_points.mapInArrow(of_block(Asked.of(b)), kind) for b in blocks(queries, size)])


def in_order(values: np.ndarray, digits: int = DIGITS) -> tuple[np.ndarray, np.ndarray]:
    """The places of rounded numbers in order of size, and the numbers so ordered; those that are none or very large come last."""
    units = np.rint(values * 10.0**digits)
    fair = np.abs(units) < 2**30
    # a number and its place in one integer: these are sorted four times as fast as by argsort
    keys = (np.where(fair, units, 2.0**30) + 2**30).astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64)
    keys.sort()
    at = keys.astype(np.uint32)
    return at, ((keys >> np.uint64(32)).astype(np.int64) - 2**30) / 10.0**digits if fair.all() else values[at]


def compared(points: DataFrame, queries: DataFrame, vector: str = "clip", similarity: bool = False, name: str = "id") -> DataFrame:
    """All pairs: ``qid``, ``id`` (called ``name``), ``by_cosine`` (rounded to six digits) and ``by_l2``, one less half the squared distance (to five), null for unlike lengths.

    With ``similarity`` the cosine goes by way of a distance, one less the cosine, whose last bits differ.  Some millions of pairs at a time come out in order of
    their cosines, so files hold runs of equal numbers and are a third as large; the whole is in no order.
    """
    kind = StructType([queries.schema["qid"]]).add(name, points.schema["id"].dataType).add("by_cosine", "double").add("by_l2", "double")

    def of_block(asked: Asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def together(p: Side, q: Side, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """``by_cosine`` and ``by_l2`` of some points with some queries."""
            cosine = products(p, slice(None), q, columns)
            odd = np.isnan(cosine)
            if odd.any():
                i, j = np.nonzero(odd)
                cosine[i, j] = cosines(p, i, q, columns[j])
            by_cosine = rounded(cosine, DIGITS, lambda at: 1.0 - (1.0 - cosines(p, at[0], q, columns[at[1]])) if similarity else cosines(p, at[0], q, columns[at[1]]))

            def half(at: tuple) -> np.ndarray:
                apart = p.m[at[0]] - q.m[columns[at[1]]]
                return 1.0 - dots(apart, apart) / 2

            with np.errstate(all="ignore"):
                halves = 1.0 - ((p.norm**2)[:, None] + (q.norm[columns] ** 2)[None, :] - 2 * (p.m @ q.m[columns].T)) / 2
                for i in np.flatnonzero(~(p.norm <= LONG)):  # of long vectors the product isn't exact enough
                    halves[i] = half((np.full(len(columns), i), np.arange(len(columns))))
                for j in np.flatnonzero(~(q.norm[columns] <= LONG)):
                    halves[:, j] = half((np.arange(len(halves)), np.full(len(halves), j)))
                return by_cosine, rounded(halves, DIGITS - 1, half)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = asked.table["qid"].combine_chunks()
            for block in in_blocks(batches, SORTED // COLUMNS):
                ids, whole = block["id"].combine_chunks(), Side(block[vector], -1)
                size = max(whole.m.shape[1], asked.q.m.shape[1])
                whole, q = whole.padded(size), asked.q.padded(size)
                for a in range(0, len(own), COLUMNS):
                    columns = np.arange(a, min(a + COLUMNS, len(own)))
                    # few points at a time, so that what is computed stays in the cache
                    parts = [together(whole.some(slice(k, k + PAIRS // COLUMNS)), q, columns) for k in range(0, len(ids), PAIRS // COLUMNS)]
                    by_cosine, by_l2 = (np.concatenate([x.ravel() for x in side]) for side in zip(*parts, strict=True))
                    order, by_cosine = in_order(by_cosine)
                    like = len(np.unique(np.concatenate([whole.size, q.size[columns]]))) == 1
                    for k in range(0, len(order), PAIRS):
                        at = order[k : k + PAIRS]
                        i = at // np.uint32(len(columns))
                        j = at - i * np.uint32(len(columns))
                        unlike = None if like else whole.size[i] != q.size[columns[j]]
                        yield pa.RecordBatch.from_arrays([own.slice(a, len(columns)).take(pa.array(j)), ids.take(pa.array(i)), pa.array(by_cosine[k : k + PAIRS]), pa.array(by_l2[at], mask=unlike)], names=kind.names)

        return run

    return reduce(DataFrame.unionByName, [dealt(points).mapInArrow(of_block(Asked.of(b)), kind) for b in blocks(queries)])


def means(points: DataFrame, queries: DataFrame, label: str, want: str, vector: str = "clip") -> DataFrame:
    """Of each query over all points of other ids: ``margin``, the mean score of the right (``label`` is ``want``) less that of the wrong, and ``floor``, the best wrong one."""
    kind = StructType([queries.schema["qid"]]).add("right", "double").add("n", "long").add("wrong", "double").add("m", "long").add("most", "double")

    def of_block(asked: Asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, wanted = asked.table["qid"].to_numpy(), np.array(asked.table[want].to_pylist(), object)
            sums, counts = np.zeros((2, len(qid))), np.zeros((2, len(qid)), np.int64)
            most = np.full(len(qid), -np.inf)
            for block in in_blocks(batches, ROWS):
                p, ids = Side(block[vector], -1), ids_of(block["id"])
                own = np.array(block[label].to_pylist(), object)
                size = max(p.m.shape[1], asked.q.m.shape[1])
                p, q = p.padded(size), asked.q.padded(size)
                codes = {v: n for n, v in enumerate({*own, *wanted} - {None})}
                left, right = (np.array([codes.get(v, none) for v in values]) for values, none in ((own, -1), (wanted, -2)))
                for a in range(0, len(qid), COLUMNS):
                    columns = np.arange(a, min(a + COLUMNS, len(qid)))
                    cosine = products(p, slice(None), q, columns)
                    odd = np.isnan(cosine)
                    if odd.any():
                        i, j = np.nonzero(odd)
                        cosine[i, j] = cosines(p, i, q, columns[j])
                    score = rounded(cosine, DIGITS, lambda at: cosines(p, at[0], q, columns[at[1]]))  # noqa: B023
                    counted = (ids[:, None] != qid[columns][None, :]) & (left >= 0)[:, None] & (right[columns] >= 0)[None, :]
                    same = left[:, None] == right[columns][None, :]
                    for k, mask in enumerate((counted & same, counted & ~same)):
                        sums[k, columns] += np.where(mask, score, 0.0).sum(0)
                        counts[k, columns] += mask.sum(0)
                    most[columns] = np.maximum(most[columns], np.where(counted & ~same, score, -np.inf).max(0))
            if counts.any():
                yield pa.RecordBatch.from_arrays([asked.table["qid"].combine_chunks(), *map(pa.array, (sums[0], counts[0], sums[1], counts[1])), pa.array(most, mask=counts[1] == 0)], names=kind.names)

        return run

    parts = reduce(DataFrame.unionByName, [dealt(points).mapInArrow(of_block(Asked.of(b)), kind) for b in blocks(queries)])
    mean = lambda s, n: F.try_divide(F.sum(s), F.sum(n))
    return parts.groupBy("qid").agg((mean("right", "n") - mean("wrong", "m")).alias("margin"), F.max("most").alias("floor"))
