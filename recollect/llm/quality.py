"""Operator 5: a quality classifier, a factorisation machine over hashed words, structure and metadata.

A document's features are its words (hashed, with damped counts of unit length), statistics of its structure (shares of symbols,
capitals, digits and repeated words and lines, lengths of words and lines, ...) and its metadata (its size in characters, lines and words,
in logarithmic steps).  Statistics come both as standardised numbers and as the step they fall in, so that pairs such as "this word
in a text of this shape" have weights.  The machine has a weight for each feature and, for each pair, the inner product of two short
vectors; by the sum-of-squares identity all pairs of a document are summed in time linear in its features:

    sum of <v_i, v_j> x_i x_j over i < j  =  1/2 sum over f of ((sum of v_if x_i)^2 - sum of (v_if x_i)^2)

It is trained in numpy on the driver with at most ``TRAIN_ROWS`` labelled rows (those whose hashed ids are least), and applied to
whole texts on the executors.  Labels, language, source and id are never features.

Defined results: a null text counts as an empty one; a score is always a number from 0 to 1; without labelled rows every score is
0.5, and with labels of one kind only every score is 0.95 or 0.05; documents labelled differently by several rows, or by null, teach
nothing; equal texts have equal scores; repeated rows are scored each; columns with an output's name are replaced; an empty table gives
an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from .shared import arrow_column, text_or_empty

#: Labelled rows that are used for training at most: a bounded sample, spread by a hash of the id.
TRAIN_ROWS = 10_000
#: Places for words, steps of each statistic, factors of a feature.
WORD_PLACES, STEPS, FACTORS = 1 << 15, 12, 8
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.05, 1e-5
#: From this score on a document is predicted to be good.
GOOD = 0.7

STATISTICS = (
    "symbols", "capitals", "digits", "shouted", "bars", "marked", "distinct", "runs", "repeated_lines", "bigrams", "word_length", "line_words",
    "top_word", "ended_lines", "size", "lines", "words",
)


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """The values of ``STATISTICS``: shares from 0 to 1, but for lengths and logarithms of sizes."""
    n, w = max(len(text), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "!*#$%&|<>{}[]\\^~=_@+"))
    marked = sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,;:?)'\"»")
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        symbols / n,
        sum(map(str.isupper, words)) / w,
        sum(map(text.count, "0123456789")) / n,
        sum(1 for x in words if x.endswith("!!")) / w,
        counts.get("|", 0) / w,
        marked / w,
        len(counts) / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        1 - len(set(lines)) / max(len(lines), 1),
        pairs / w,
        sum(map(len, words)) / w / 20,
        w / max(len(lines), 1) / 200,
        (max(counts.values()) if counts else 0) / w,
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / max(len(lines), 1),
        np.log1p(len(text)) / 12,
        np.log1p(len(lines)) / 8,
        np.log1p(len(words)) / 10,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values.  Words come first, then the steps of the statistics, then the statistics themselves."""
    words = text.split()
    counts = Counter(words)
    places = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) % WORD_PLACES for x in counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(values):
        values /= np.sqrt(np.dot(values, values))
    stats = np.array(statistics(text, words, counts), np.float32)
    steps = np.minimum((np.clip(stats, 0, 1) * STEPS).astype(np.int64), STEPS - 1)
    k = len(STATISTICS)
    return (
        np.concatenate([places, WORD_PLACES + np.arange(k) * STEPS + steps, WORD_PLACES + k * STEPS + np.arange(k)]),
        np.concatenate([values, np.full(k, 0.5, np.float32), stats]).astype(np.float32),
    )


SIZE = WORD_PLACES + len(STATISTICS) * (STEPS + 1)


@dataclass
class Machine:
    """``bias``, ``w`` (a weight for each feature), ``v`` (its factors); ``shift`` puts the best cut at a score of ``GOOD``."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    shift: float = 0.0
    constant: float | None = None

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Margins of rows, and what their gradients need: places, values, begins and the factors' sums."""
        begins = np.cumsum([0, *(len(p) for p, _ in rows[:-1])])
        places, values = np.concatenate([p for p, _ in rows]), np.concatenate([x for _, x in rows])
        scaled = self.v[places] * values[:, None]
        sums, squares = np.add.reduceat(scaled, begins), np.add.reduceat(scaled * scaled, begins)
        linear = np.add.reduceat(self.w[places] * values, begins)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1), places, values, begins, sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        out = [self.margins(rows[a : a + BATCH])[0] for a in range(0, len(rows), BATCH)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out).astype(np.float64) + self.shift, -30, 30))) if out else np.zeros(0)


def best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin with the greatest balanced accuracy; the middle of the widest stretch of such."""
    order = np.argsort(margins)
    m, y = margins[order], labels[order]
    bad_below = np.concatenate([[0], np.cumsum(y == 0)]) / max((y == 0).sum(), 1)
    good_below = np.concatenate([[0], np.cumsum(y == 1)]) / max((y == 1).sum(), 1)
    gain = bad_below - good_below
    edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> Machine:
    """Logistic loss with both labels of equal weight, AdaGrad, a tenth of the rows kept apart to place the cut."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32))
    if not len(labels) or labels.min() == labels.max():
        machine.constant = 0.5 if not len(labels) else (0.95 if labels[0] else 0.05)
        return machine
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    grown_w, grown_v, grown_b = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32), 1e-6
    apart = np.arange(len(rows)) % 10 == 9 if len(rows) >= 500 else np.zeros(len(rows), bool)
    learnt = np.flatnonzero(~apart)
    for _ in range(EPOCHS):
        order = rng.permutation(learnt)
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            margin, places, values, begins, sums = machine.margins([rows[i] for i in chosen])
            slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            row = np.repeat(np.arange(len(chosen)), np.diff([*begins, len(places)]))
            touched, where = np.unique(places, return_inverse=True)
            g = slope[row] * values
            gw = np.bincount(where, g, len(touched)).astype(np.float32) + DECAY * machine.w[touched]
            each = g[:, None] * (sums[row] - machine.v[places] * values[:, None])
            gv = np.stack([np.bincount(where, each[:, f], len(touched)) for f in range(FACTORS)], 1).astype(np.float32)
            gv += DECAY * machine.v[touched]
            grown_w[touched] += gw * gw
            grown_v[touched] += gv * gv
            grown_b += float(slope.sum()) ** 2
            machine.w[touched] -= RATE * gw / np.sqrt(grown_w[touched])
            machine.v[touched] -= RATE * gv / np.sqrt(grown_v[touched])
            machine.bias -= RATE * float(slope.sum()) / grown_b**0.5
    used = np.flatnonzero(apart) if apart.any() and 0 < labels[apart].mean() < 1 else learnt
    margins = np.concatenate([machine.margins([rows[i] for i in used[a : a + BATCH]])[0] for a in range(0, len(used), BATCH)])
    machine.shift = float(np.log(GOOD / (1 - GOOD))) - best_cut(margins, labels[used])
    return machine


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether no label of a row may be learnt: a fixed quarter of all ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


FEATURES = StructType([StructField("places", ArrayType(IntegerType())), StructField("values", ArrayType(FloatType()))])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """Train on ``labels`` (``doc_id``, ``label`` 0 or 1) of ``docs``; at most ``rows`` labelled rows are used."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"), F.count("y").alias("n"), F.count("*").alias("m"))
    known = known.filter("y = z AND n = m AND y IN (0, 1)").select("id", "y", F.xxhash64("id").alias("h"))
    chosen = known.orderBy("h", "id").limit(rows)  # so many rows at most, so they may be sent to all tasks
    have = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("t")).join(F.broadcast(chosen), "id")

    def start():
        def batch(texts: list[str]) -> pa.Array:
            found = [features(t) for t in texts]
            return pa.StructArray.from_arrays(
                [pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))],
                names=["places", "values"],
            )

        return batch

    have = have.withColumn("f", arrow_column(have, start, FEATURES, F.col("t")))
    got = have.groupBy("id", "h").agg(F.first("y").alias("y"), F.min("f").alias("f")).orderBy("h", "id").select("y", "f.places", "f.values")
    collected = got.toArrow()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for places, values in zip(collected["places"].chunks, collected["values"].chunks, strict=True):
        cuts = np.asarray(places.offsets) - places.offsets[0].as_py()
        p, x = places.flatten().to_numpy(), values.flatten().to_numpy()
        found += [(p[a:b], x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return train(found, np.array(collected["y"].to_pylist(), np.float64))


def with_score(df: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the score of each whole text."""

    def start():
        return lambda texts: pa.array(machine.scores([features(t) for t in texts]), pa.float64())

    return df.withColumn(name, arrow_column(df, start, DoubleType(), text_or_empty(text)))
