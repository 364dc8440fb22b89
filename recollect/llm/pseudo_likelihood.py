"""Operator 10: language-model scores by masked pseudo-likelihood.

A window network predicts each token from the tokens on both sides of it, the token itself masked.  Each of the ``WINDOW`` words to the
left and to the right has a vector (a table for each side); their sum goes through a softmax over ``UNITS`` hidden units, and each
unit has a distribution over the whole vocabulary, so the token's probability is sum_k h_k q_k(token).  The sum of a document's
conditional log-probabilities is its score; per token it tells fluent text from noise, whatever the length.

The vocabulary is counted over all documents and grows with them: every word seen sqrt(number of tokens) / ``RARE`` times (twice at
least).  All other words are one class of the distributions, and within it a word has the probability of its spelling, by a chain of
bytes that is counted over the corpus's rare words; so each string has a probability of its own and all of them sum to one.  As a
neighbour a rare word is known by its last two letters.

Training begins with a start: about ``START`` tokens of rows chosen by a hash are gone over ``EPOCHS`` times, which gives the units
different parts to play.  Then all rows are learnt from in rounds, each row in the round that a hash gives it, each round with three times
the rows of the last.  In a round rows are dealt by the hash to parts of about ``PART`` tokens and ordered by it there; each part trains
the side tables by gradient steps from the round's start, and the round ends with their mean by tokens.  The units' distributions are
expected counts summed over all parts of a round (a step of expectation maximisation, which has no order).  So how the input is split over
tasks changes scores by rounding alone, and a lost task is done again alike.

The vocabulary and the network, which are sent back to all tasks, grow about as the square root of the corpus.

Defined results: a null text counts as an empty one; a text without words has no tokens, score 0 and mean 0; an empty corpus gives
no rows; equal texts have equal scores, repeated rows are scored each and teach each; columns with an output's name are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StructField, StructType, VariantType

from .shared import arrow_column, bounded_batches, text_or_empty, with_fields, written

#: Neighbours on each side, hidden units, and places of rare neighbours.
WINDOW, UNITS, PLACES = 4, 32, 256
#: A word seen sqrt(tokens) / RARE times is in the vocabulary.
RARE = 50
#: Tokens of a gradient step, of a part, and of the start; how often that is gone over; shares of the rounds.
BATCH, PART, START, EPOCHS = 8192, 1 << 20, 1 << 19, 8
SHARES = (1, 3, 9)
START_RATE, RATE = 0.05, 0.02
#: A unit's distribution is mixed with the words' own frequencies.
MIXED = 0.01
#: Occurrences of a token in a gradient step up to which it is a short run.
SHORT = 16
#: Words whose tokens are kept in memory, and the longest of them.
KEPT_WORDS, KEPT_CHARS = 150_000, 40
#: Tokens scored at once, networks averaged at once, numbers of a network in a piece, parts of a task at most.
AT_ONCE, AVERAGED, PIECE, PARTS = 1 << 15, 32, 1 << 18, 8
END = 256


class Words(dict):
    """Tokens of the words of the vocabulary, most frequent first; how often each, and all others together, are seen; logarithms of the spelling."""

    def __init__(self, words: list[str] = (), counts: list[int] = (), others: int = 0, pairs: np.ndarray | None = None):
        super().__init__({w: k for k, w in enumerate(words)})
        self.seen = np.array([*counts, others], np.float64)
        pairs = np.zeros((END + 1, END + 1)) if pairs is None else pairs
        self.spelling = np.log((pairs + 1) / (pairs + 1).sum(1, keepdims=True)).astype(np.float32)

    @property
    def total(self) -> int:
        return int(self.seen.sum())

    def frequencies(self) -> np.ndarray:
        return (self.seen + 0.01) / (self.seen + 0.01).sum()


def byte_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bytes in a row of all words one after the other, an end before and after each; where each word's pairs begin."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    ends = np.cumsum(sizes)
    chain = np.full(int(ends[-1]) + 1 if len(ends) else 1, END, np.int64)
    at = np.ones(len(chain), bool)
    at[0], at[ends] = False, False
    chain[at] = np.frombuffer(b"".join(data), np.uint8)
    return chain[:-1] * (END + 1) + chain[1:], ends - sizes


PAIR = StructType().add("pair", "integer").add("n", "long")


def vocabulary(docs: DataFrame, text: str = "text") -> Words:
    """The vocabulary and the spelling of the whole corpus."""
    words = docs.select(F.explode(F.split(text_or_empty(text), "\\s+")).alias("w")).filter("w <> ''")
    counted = written(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(2.0, total**0.5 / RARE)
    found = counted.filter(often).orderBy(F.desc("n"), "w").toArrow()

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, found = np.zeros((END + 1) ** 2), []
        for batch in batches:
            pairs, begins = byte_pairs(batch.column(0).to_pylist())
            found.append((pairs, np.repeat(batch.column(1).to_numpy(), np.diff(np.append(begins, len(pairs))))))
            if sum(len(p) for p, _ in found) > PIECE:
                sums += np.bincount(np.concatenate([p for p, _ in found]), np.concatenate([n for _, n in found]), len(sums))
                found = []
        for pairs, n in found:
            sums += np.bincount(pairs, n, len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.int64))], names=PAIR.names)

    rows = counted.filter(~often).mapInArrow(spelled, PAIR).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 257 x 257 at most
    pairs = np.zeros((END + 1) ** 2)
    pairs[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    counts = found["n"].to_pylist()
    return Words(found["w"].to_pylist(), counts, total - sum(counts), pairs.reshape(END + 1, END + 1))


class Tokens(dict):
    """Tokens of words; a rare word's is that of its last two letters' place.  A bounded number of rare words is kept."""

    def __init__(self, words: Words):
        super().__init__(words)
        self.first = len(words)

    def __missing__(self, word: str) -> int:
        token = self.first + zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % PLACES
        if len(self) < self.first + KEPT_WORDS and len(word) <= KEPT_CHARS:
            self[word] = token
        return token


def sums_of_runs(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The sums of the runs of ``rows`` that begin there: most runs are short, and those are added a row of all of them at a time."""
    sizes = np.diff(np.append(begins, len(rows)))
    out, short = rows[begins], np.flatnonzero(sizes <= SHORT)
    for k in range(1, SHORT):
        short = short[sizes[short] > k]
        out[short] += rows[begins[short] + k]
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = rows[begins[i] : begins[i] + sizes[i]].sum(0)
    return out


class Network:
    """``left``, ``right``: vectors of neighbours by token (the last, none, is zero); ``bias``; ``q``: the units' distributions."""

    def __init__(self, words: Words, tables: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.rare, self.none = len(words), len(words) + PLACES
        self.spelling, self.frequencies = words.spelling, words.frequencies()
        rows = self.none + 1
        if tables is None:
            tables = np.random.default_rng(7).normal(0, 0.1, (2 * rows + 1) * UNITS)
        self.tables = np.array(tables, np.float32)
        self.left, self.right, self.bias = (p.reshape(-1, UNITS) for p in np.split(self.tables, [rows * UNITS, 2 * rows * UNITS]))
        self.left[self.none] = self.right[self.none] = 0
        self.tell(self.first_counts() if counts is None else counts)

    def first_counts(self) -> np.ndarray:
        """The words' own frequencies, a little different for each unit."""
        return 50_000 * self.frequencies[:, None] * (1 + np.random.default_rng(1).random((self.rare + 1, UNITS)))

    def tell(self, counts: np.ndarray) -> None:
        """The units' distributions from expected counts of words by units."""
        counts = np.array(counts, np.float64).reshape(-1, UNITS)
        self.q = ((1 - MIXED) * counts / np.maximum(counts.sum(0), 1e-9) + MIXED * self.frequencies[:, None]).astype(np.float32)
        empty = counts.sum(0) <= 1e-9
        self.q[:, empty] = self.frequencies[:, None]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """Hidden units of the tokens ``x[WINDOW:-WINDOW]``."""
        left, right, n = self.left[x], self.right[x], len(x) - 2 * WINDOW
        z = left[:n] + self.bias
        for k in range(1, WINDOW):
            z += left[k : k + n]
        for k in range(WINDOW + 1, 2 * WINDOW + 1):
            z += right[k : k + n]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of the tokens ``x[WINDOW:-WINDOW]``, without the spelling; what is said of ``none`` means nothing."""
        out = np.empty(max(len(x) - 2 * WINDOW, 0), np.float32)
        for a in range(0, len(out), AT_ONCE):
            part = x[a : a + AT_ONCE + 2 * WINDOW]
            h = self.hidden(part)
            h *= self.q[np.minimum(part[WINDOW:-WINDOW], self.rare)]
            out[a : a + len(h)] = np.log(h.sum(1))
        return out

    def spelled(self, words: list[str]) -> np.ndarray:
        """Logarithms of the probabilities of the spelling of words."""
        pairs, begins = byte_pairs(words)
        return np.add.reduceat(self.spelling.ravel()[pairs], begins) if len(words) else np.zeros(0, np.float32)

    def slopes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the tokens ``x[WINDOW:-WINDOW]``: each unit's share in predicting it, and the gradient of its log-probability at the units' inputs."""
        own = x[WINDOW:-WINDOW]
        h = self.hidden(x)
        share = h * self.q[np.minimum(own, self.rare)]
        share /= share.sum(1, keepdims=True)
        share[own == self.none] = 0
        h[own == self.none] = 0
        return share, share - h

    def learn(self, x: np.ndarray, rate: float, counts: np.ndarray) -> None:
        """A gradient step on the tokens ``x[WINDOW:-WINDOW]``; the units' shares in words are added to ``counts``."""
        share, g = self.slopes(x)
        n = len(g)
        sides = np.zeros((len(x), 3 * UNITS), np.float32)
        for k in range(WINDOW):
            sides[k : k + n, :UNITS] += g
            sides[k + WINDOW + 1 : k + WINDOW + 1 + n, UNITS : 2 * UNITS] += g
        sides[WINDOW : WINDOW + n, 2 * UNITS :] = share
        order = np.argsort(x.astype(np.uint16) if self.none < 1 << 16 else x, kind="stable")  # short integers sort in linear time
        token = x[order]
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sums, token = sums_of_runs(sides[order], begins), token[begins]
        # a vector moves by the mean slope of its places times the root of their number
        size = rate / np.sqrt(np.diff(np.append(begins, len(x))))[:, None].astype(np.float32)
        real = token < self.none
        self.left[token[real]] += (size * sums[:, :UNITS])[real]
        self.right[token[real]] += (size * sums[:, UNITS : 2 * UNITS])[real]
        self.bias += rate / n**0.5 * g.sum(0)
        own = token < self.rare
        counts[token[own]] += sums[own, 2 * UNITS :]
        counts[self.rare] += sums[~own, 2 * UNITS :].sum(0)


def stream(texts: list[str], known: Tokens, none: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of texts; their tokens with ``WINDOW`` times ``none`` before the first, between two and after the last; where each text begins."""
    each = [t.split() for t in texts]
    words = [w for one in each for w in one]
    sizes = np.array([len(one) for one in each], np.int64)
    begins = np.cumsum(sizes) - sizes + WINDOW * np.arange(1, len(each) + 1)
    out = np.full(len(words) + WINDOW * (len(each) + 1), none, np.int32)
    out[np.arange(len(words)) + np.repeat(WINDOW * np.arange(1, len(each) + 1), sizes)] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return words, out, begins


class Part:
    """Gradient steps on the texts of a part as they come."""

    def __init__(self, network: Network, rate: float, counts: np.ndarray):
        self.network, self.rate, self.counts = network, rate, counts
        self.left, self.seen = np.full(WINDOW, network.none, np.int32), 0

    def add(self, texts: list[str], known: Tokens) -> None:
        words, x, _ = stream(texts, known, self.network.none)
        self.seen += len(words)
        x = np.concatenate([self.left[:-WINDOW], x])
        while len(x) >= BATCH + 2 * WINDOW:
            self.network.learn(x[: BATCH + 2 * WINDOW], self.rate, self.counts)
            x = x[BATCH:]
        self.left = x

    def finish(self) -> int:
        """The rest of the part; its number of tokens."""
        if len(self.left) > 2 * WINDOW:
            self.network.learn(self.left, self.rate, self.counts)
        return self.seen


def started(words: Words, texts: Iterator[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Tables and expected counts after going over the first ``START`` tokens of ``texts`` a few times."""
    known, network, heard = Tokens(words), Network(words), [np.full(WINDOW, len(words) + PLACES, np.int32)]
    for some in texts:
        _, x, _ = stream(some, known, network.none)
        heard.append(x[WINDOW:])
        if sum(map(len, heard)) >= START:
            break
    x, counts = np.concatenate(heard)[: START + 2 * WINDOW], network.first_counts()
    for a in [*range(0, len(x) - 2 * WINDOW, 8 * BATCH)] * EPOCHS:
        new = np.zeros_like(counts)
        for b in range(a, min(a + 8 * BATCH, len(x) - 2 * WINDOW), BATCH):
            network.learn(x[b : b + BATCH + 2 * WINDOW], START_RATE, new)
        counts = 0.9 * counts + new  # distributions follow after a few steps
        network.tell(counts)
    return network.tables, counts


LEARNT = StructType().add("task", "long").add("tokens", "long").add("piece", "long").add("counts", "boolean").add("flat", "binary")


def piece_of(task: int, tokens: int, piece: int, counts: bool, flat: np.ndarray) -> dict:
    """A piece of what a task has learnt: mean changes of the tables as short floats, or sums of expected counts."""
    return {"task": task, "tokens": tokens, "piece": piece, "counts": counts, "flat": flat.astype("<f4" if counts else "<f2").tobytes()}


def numbers(flat: bytes, counts: bool) -> np.ndarray:
    return np.frombuffer(flat, "<f4" if counts else "<f2").astype(np.float64)


def pieces(tables: np.ndarray, counts: np.ndarray, tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for kind, flat in ((False, tables), (True, counts.ravel())):
        for k in range(0, len(flat), PIECE):
            one = piece_of(task, tokens, k // PIECE, kind, flat[k : k + PIECE])
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in one.items()})


def summed(learnt: DataFrame, words: Words, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``tasks`` tasks have learnt, a bounded number of them at a time: the mean of tables by tokens, the sum of counts."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        kind, tokens, first = bool(group["counts"].iloc[0]), int(group["tokens"].sum()), group.iloc[0]
        share = np.ones(len(group)) if kind else group["tokens"].to_numpy() / max(tokens, 1)
        flat = sum(numbers(f, kind) * n for f, n in zip(group["flat"], share, strict=True))
        return pd.DataFrame([piece_of(int(first["task"]) // AVERAGED, tokens, int(first["piece"]), kind, flat)])

    while tasks > 1:  # tasks are numbered from 0, so each step divides their numbers
        learnt = learnt.groupBy("counts", "piece", F.floor(F.col("task") / AVERAGED)).applyInPandas(add, LEARNT)
        tasks = -(-tasks // AVERAGED)
    rows = 2 * (len(words) + PLACES + 1) + 1
    tables, counts = np.zeros(rows * UNITS), np.zeros((len(words) + 1) * UNITS)
    for r in written(learnt, "learnt").select("counts", "piece", "flat").toLocalIterator():
        flat = numbers(bytes(r.flat), r.counts)
        (counts if r.counts else tables)[r.piece * PIECE : r.piece * PIECE + len(flat)] = flat
    return tables, counts


def row_hash(docs: DataFrame) -> Column:
    """A hash of each row, so that copies of one text are dealt to different parts."""
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, ArrayType | MapType | StructType | VariantType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def trained(docs: DataFrame, words: Words, text: str = "text") -> Network:
    """A network trained on all tokens of ``docs``."""
    bounded_batches(docs.sparkSession)
    if not words.total:
        return Network(words)
    rows = docs.select(row_hash(docs).alias("h"), text_or_empty(text).alias("t"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces(*started(words, (b.column(0).to_pylist() for b in batches)), START)

    # the least hashes: the share of all tokens that makes START
    least = int(min(START / words.total, 1.0) * 2**53)
    first = rows.filter(F.col("h").bitwiseAND(2**53 - 1) <= least).repartition(1).sortWithinPartitions("h", "t").select("t")
    tables, counts = summed(first.mapInArrow(start, LEARNT), words, 1)

    for k, share in enumerate(SHARES):
        parts = max(-(-words.total * share // (sum(SHARES) * PART)), 1)
        turn = F.pmod("h", F.lit(sum(SHARES)))
        here = rows.filter((turn >= sum(SHARES[:k])) & (turn < sum(SHARES[: k + 1])))
        here = here.withColumn("part", F.pmod(F.shiftright("h", 16), F.lit(parts)))
        tasks = min(parts, max(docs.sparkSession.sparkContext.defaultParallelism, -(-parts // PARTS)))
        here = here.repartition(tasks, "part").sortWithinPartitions("part", "h").select("part", "t")

        def learn(batches: Iterator[pa.RecordBatch], tables: np.ndarray = tables, counts: np.ndarray = counts) -> Iterator[pa.RecordBatch]:
            known, network = Tokens(words), Network(words, tables, counts)
            moved, told, tokens, now, part = np.zeros(len(tables)), np.zeros((len(words) + 1, UNITS)), 0, None, None
            for batch in batches:
                of, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                edges = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    if of[a] != now:
                        if part:
                            seen = part.finish()
                            moved, tokens = moved + seen * (network.tables - tables), tokens + seen
                            network.tables[:] = tables
                        now, part = of[a], Part(network, RATE, told)
                    part.add(texts[a:b], known)
            if part:
                seen = part.finish()
                moved, tokens = moved + seen * (network.tables - tables), tokens + seen
                yield from pieces(moved / max(tokens, 1), told, tokens)

        moved, told = summed(here.mapInArrow(learn, LEARNT), words, tasks)
        tables, counts = tables + moved, told if told.any() else counts
    return Network(words, tables, counts)


SCORED = StructType([StructField("n_tokens", LongType()), StructField("log_likelihood", DoubleType()), StructField("mean", DoubleType())])


def scored(df: DataFrame, words: Words, network: Network, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``log_likelihood`` (the sum over its tokens) and ``mean`` (per token)."""

    def start():
        known = Tokens(words)

        def batch(texts: list[str]) -> pa.Array:
            strings, x, begins = stream(texts, known, network.none)
            sizes = np.diff(np.append(begins, len(x))) - WINDOW
            logs = network.log_probabilities(x)
            at = np.flatnonzero(x[WINDOW:-WINDOW] != network.none)
            logs = logs[at].astype(np.float64)
            rare = np.flatnonzero(x[WINDOW + at] >= network.rare)
            logs[rare] += network.spelled([strings[k] for k in rare.tolist()])
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            ends = np.cumsum(sizes)
            sums = sums[ends] - sums[ends - sizes]
            return pa.StructArray.from_arrays([pa.array(sizes), pa.array(np.round(sums, 3)), pa.array(np.round(sums / np.maximum(sizes, 1), 5))], names=SCORED.names)

        return batch

    return with_fields(df, arrow_column(df, start, SCORED, text_or_empty(text)), SCORED)


def score(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` scored by a network trained on ``df`` itself."""
    words = vocabulary(df, text)
    return scored(df, words, trained(df, words, text), text)
