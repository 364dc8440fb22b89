"""Operator 12: ranked lexical search with inverted treaps.

Each term of the queries has, within a shard of documents, a treap: a binary tree in search order of the documents' places and in heap
order of the term's impact on a document's score.  A subtree is thus an interval of places whose greatest impact stands at its root.
A query walks the treaps of its terms at once.  A state is an interval with one subtree for each term; the roots' impacts add up to
a bound for all documents within.  A state whose bound is below the k-th best score so far is dropped with all that it holds.
Otherwise the document at the root of most impact is scored (by descent in the treaps) and splits the interval, and with it
each subtree, in two.  States are taken in blocks, those of the highest bounds first, and a block is walked in numpy at once.

Spark deals the work: each task reads a part of the written postings (the terms of the queries, their numbers of occurrences, and the length
of each document), builds treaps for a shard of a bounded number of documents and postings at a time, and keeps the ``k`` best of each
query for all its shards, so later shards are pruned by earlier ones.  The tasks' best meet by query, in two steps.  Nothing is sharded by
term, so frequent terms are spread like all others.  Queries are read in blocks of ``BLOCK``.

A score is a sum over the query's different terms of

    w * ((10^9 tf) div (1000 tf + 20 m)),  w = floor(1000 ln((2N + 2) / (2 df + 1))),  m = 50 + (50 n N) div L

with N documents of at least one term, L their terms with repeats, n one document's, df a term's documents, tf its occurrences in one.

Defined results: null texts count as empty ones and have no terms; documents with a score of 0 are no results; equal scores go by
ascending doc_id, null last, and repeated rows are results each; a query without terms has no results; each row of the queries is
a query of its own, also where ids repeat or are null; empty tables give empty ones; other columns of either table play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .shared import bounded_batches, text_or_empty, written

#: Queries that are answered in one pass over the documents, and results of each.
BLOCK, BEST = 1000, 50
#: Documents and postings of a shard at most.
SHARD_ROWS, SHARD_POSTINGS = 1 << 15, 1 << 21
#: States that are walked at once.
STATES = 1024
#: In how many parts the tasks' best of a query meet first.
PARTS = 64

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str) -> list[bytes]:
    """ASCII letters in lower case, digits, and all that is not ASCII; bytes, of which lower() changes A-Z alone."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def postings(docs: DataFrame, wanted: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """A written table of ``doc_id``, ``n`` (terms with repeats) and, of the wanted terms, numbers and occurrences."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    kind = StructType([rows.schema["doc_id"]]).add("n", "long").add("terms", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for t in batch.column("t").to_pylist():
                all_terms = terms_of(t)
                held = Counter(k for k in map(wanted.get, all_terms) if k is not None)
                sizes.append(len(all_terms))
                terms.append(list(held))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=kind.names)

    return written(rows.mapInArrow(run, kind), "postings")


class Shard:
    """The treaps of some documents' postings, all in one set of arrays; the node of a term's root is ``roots[term]``, -1 if it has none."""

    def __init__(self, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, total: int):
        m = 50 + (50 * n * documents) // max(total, 1)
        place = np.repeat(np.arange(len(n)), lengths)
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[place]))
        order = np.lexsort((place, terms))
        self.place, self.impact = place[order].astype(np.int32), impact[order]
        terms = terms[order]
        self.left, self.right = self.trees(terms.tolist(), self.impact.tolist())
        self.roots = np.full(len(weights), -1, np.int32)
        self.roots[terms[self.top]] = self.top

    def trees(self, terms: list[int], impact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Left and right nodes: the rightmost path is a stack, from which each next node takes the lower ones as its left subtree."""
        left, right, top = [-1] * len(terms), [-1] * len(terms), []
        stack: list[int] = []
        now = -1
        for k, term in enumerate(terms):
            if term != now:
                if stack:
                    top.append(stack[0])
                stack, now = [], term
            value, last = impact[k], -1
            while stack and impact[stack[-1]] < value:
                last = stack.pop()
            left[k] = last
            if stack:
                right[stack[-1]] = k
            stack.append(k)
        if stack:
            top.append(stack[0])
        self.top = np.array(top, np.int64)
        return np.array(left, np.int32), np.array(right, np.int32)

    def within(self, nodes: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The roots of the parts of subtrees between two places: down towards them while a node lies outside."""
        now = nodes.copy()
        open_ = np.flatnonzero(now >= 0)
        while len(open_):
            v = now[open_]
            p = self.place[v]
            low, high = p <= above[open_], p >= below[open_]
            out = low | high
            open_, v = open_[out], v[out]
            now[open_] = np.where(low[out], self.right[v], self.left[v])
            open_ = open_[now[open_] >= 0]
        return now

    def found(self, nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Impacts at the places ``at`` in subtrees, 0 where a subtree doesn't hold the place."""
        value, now = np.zeros(len(nodes), np.int64), nodes.copy()
        open_ = np.flatnonzero(now >= 0)
        while len(open_):
            v = now[open_]
            here = self.place[v] == at[open_]
            value[open_[here]] = self.impact[v[here]]
            open_, v = open_[~here], v[~here]
            now[open_] = np.where(self.place[v] > at[open_], self.left[v], self.right[v])
            open_ = open_[now[open_] >= 0]
        return value

    def best(self, terms: np.ndarray, k: int, least: int, states: int = STATES) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of all documents that may be among the ``k`` best with a score of ``least`` or more; how many were scored."""
        roots = self.roots[terms]
        waiting = roots[roots >= 0][None]
        bounds, span = self.impact[waiting].sum(1), np.array([[-1, 1 << 30]], np.int32)  # places before and after each interval
        places, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        least = max(least, 1)
        while len(waiting):
            keep = bounds >= least
            if not keep.all():
                waiting, bounds, span = waiting[keep], bounds[keep], span[keep]
                if not len(waiting):
                    break
            order = np.argpartition(-bounds, states) if len(waiting) > states else np.arange(len(waiting))
            now, ends, order = waiting[order[:states]], span[order[:states]], order[states:]
            waiting, bounds, span = waiting[order], bounds[order], span[order]
            held = np.where(now >= 0, self.impact[now], -1)
            split = self.place[now[np.arange(len(now)), held.argmax(1)]]
            flat, at = now.ravel(), np.repeat(split, now.shape[1])
            value = self.found(flat, at).reshape(now.shape).sum(1)
            scored += len(now)
            good = value >= least
            places, scores = np.concatenate([places, split[good]]), np.concatenate([scores, value[good]])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                good = scores >= least
                places, scores = places[good], scores[good]
            both = np.concatenate([now, now])
            ends = np.concatenate([np.stack([ends[:, 0], split], 1), np.stack([split, ends[:, 1]], 1)])
            each = lambda x: np.repeat(x, now.shape[1])
            both = self.within(both.ravel(), each(ends[:, 0]), each(ends[:, 1])).reshape(both.shape)
            sums = np.where(both >= 0, self.impact[both], 0).sum(1)
            keep = sums >= least
            waiting, bounds, span = np.concatenate([waiting, both[keep]]), np.concatenate([bounds, sums[keep]]), np.concatenate([span, ends[keep]])
        return places, scores, scored


def walked(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """``query``, ``doc_id`` and ``score`` of what may be among the ``k`` best of each query; each task gives ``k`` of each at most."""
    kind = StructType().add("query", "integer").add("doc_id", "long").add("score", "long")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        some, rows, size = [], 0, 0
        for batch in batches:
            some.append(batch)
            rows, size = rows + batch.num_rows, size + len(batch.column("terms").flatten())
            if rows >= SHARD_ROWS or size >= SHARD_POSTINGS:
                yield some
                some, rows, size = [], 0, 0
        if rows:
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query the best so far: ids (a null sorts after all others), whether the id is null, scores
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in queries]
        for some in shards(batches):
            table = pa.Table.from_batches(some).combine_chunks()
            ids = table["doc_id"].combine_chunks()
            none = np.asarray(ids.is_null())
            own = ids.fill_null(0).to_numpy()
            order = pa.array(np.lexsort((own, none)))  # search order
            table, own, none = table.take(order).combine_chunks(), own[order], none[order]
            column = lambda name: table[name].combine_chunks()
            flat = lambda name: column(name).flatten().to_numpy().astype(np.int64)
            lengths = np.asarray(column("terms").value_lengths())
            shard = Shard(table["n"].to_numpy(), lengths, flat("terms"), flat("counts"), weights, documents, total)
            for q, terms in enumerate(queries):
                ids_q, none_q, scores_q = best[q]
                places, scores, _ = shard.best(terms, k, int(scores_q[-1]) if len(scores_q) >= k else 0)
                if len(places):
                    ids_q, none_q, scores_q = np.concatenate([ids_q, own[places]]), np.concatenate([none_q, none[places]]), np.concatenate([scores_q, scores])
                    first = np.lexsort((ids_q, none_q, -scores_q))[:k]
                    best[q] = ids_q[first], none_q[first], scores_q[first]
        for q, (ids_q, none_q, scores_q) in enumerate(best):
            if len(ids_q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids_q), q, np.int32)), pa.array(ids_q, mask=none_q), pa.array(scores_q)], names=kind.names)

    return index.select("doc_id", "n", "terms", "counts").mapInArrow(run, kind)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of each row of ``items``."""
    spark = docs.sparkSession
    schema = StructType([StructField("query", IntegerType()), StructField("item_id", items.schema[item_id].dataType)])
    rows = items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("t")).toLocalIterator()
    parts, some = [], []

    def answer() -> None:
        wanted: dict[bytes, int] = {}
        queries = [np.array([wanted.setdefault(t, len(wanted)) for t in dict.fromkeys(terms_of(r["t"]))], np.int64) for r in some]
        index = postings(docs, wanted, text, doc_id)
        documents, total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = {r["term"]: r["df"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held[t] + 1))) if t in held else 0 for t in range(len(wanted))], np.int64)
        found = walked(index, queries, weights, documents, total, k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("part", F.spark_partition_id() % PARTS)
        found = found.withColumn("rank", first(["query", "part"])).filter(F.col("rank") <= k).drop("part")
        found = found.withColumn("rank", first(["query"])).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(some)], schema)
        parts.append(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))

    for row in rows:
        some.append(row)
        if len(some) >= block:
            answer()
            some = []
    if some or not parts:
        answer()
    return reduce(DataFrame.unionByName, parts)
