"""Operator 11: toxic passages by maximum-scoring segments over token log-odds.

A token's score is the logarithm of how much likelier it is in toxic than in clean documents, each estimate smoothed by a Dirichlet prior
in proportion to the token's share of *all* documents.  Tokens whose counts prove no difference share one score, that of all of them
together, which is a little below zero.  A passage is a segment whose score no extension and no part surpasses; one scan in linear time
(after Ruzzo and Tompa) finds all of them.  Long clean texts have high segments by chance, so scores are calibrated by the extreme-value
law of such maxima: among ``n`` clean tokens, about ``K n exp(-L s)`` segments reach the score ``s``.  ``L`` follows from the tokens' scores
and clean frequencies, ``K`` is fitted to the clean training documents.  A document's evidence is the sum of ``-ln E`` over its passages with
``E`` below 1, and a logistic curve makes it a score, placed so that the best cut of the training documents lies at ``TOXIC``.

Counts are of documents, not of occurrences, and copies of a passage count once: each document brings the least hash of a word's
neighbourhoods, and equal ones are one.  So a mislabelled text with many copies doesn't teach its rare words.

At most ``TRAIN_ROWS`` labelled rows are learnt from (those whose hashed ids are least); the prior counts all documents.

Defined results: a null text counts as an empty one, and a text without tokens has no passage; without toxic labels, or without tokens that
prove a difference, every score is 0; with toxic labels alone every score is 1; documents labelled differently by several rows, or
by null, teach nothing; equal texts have equal scores; repeated rows are scored each; columns with an output's name are replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .quality import best_cut
from .shared import arrow_column, bounded_batches, text_or_empty, with_fields, written

#: Labelled rows that are used for training at most: a bounded sample, spread by a hash of the id.
TRAIN_ROWS = 20_000
#: From this score on a document is predicted to be toxic.
TOXIC = 0.3
#: A token proves a difference from so many independent toxic documents on, and from this signed root of the likelihood ratio on.
DOCUMENTS, PROOF = 4, 4.5
#: Weight of the prior against the labelled documents' counts.
PRIOR = 0.01
#: Passages of a lesser expected number among clean texts are significant.
SIGNIFICANT = 0.05
#: Rows of a batch of words, which bounds memory for very long texts.
AT_ONCE = 1 << 16

WORD = re.compile(r"\w+")
PASSAGE = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType()), StructField("expected", DoubleType())])
SCORED = StructType([StructField("score", DoubleType()), StructField("passages", ArrayType(PASSAGE))])


def lowered(text: str) -> str:
    """The text in lower case, letter by letter where a letter's lower case is longer, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return WORD.findall(lowered(text))


def segments(places: list[int], scores: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first and last token, score) of tokens that score ``rest`` each but for those at ``places``.

    Each candidate keeps the sum of all scores before it and up to its end, and the last earlier candidate with a lower sum before it.
    If that one also ended lower, the new candidate takes in everything from there, and is looked at again.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum at the end, the earlier candidate
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        low = total + rest * (place - at)
        total, at = low + score, place + 1
        if score <= 0:
            continue
        first = place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, place, low, total, j))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(x[0], x[1], x[3] - x[2]) for x in found]


@dataclass
class Model:
    """Scores of tokens, that of all others, the two numbers of the extreme-value law, and the curve from evidence to score."""

    scores: dict[str, float] = field(default_factory=dict)
    rest: float = 0.0
    scale: float = 1.0
    density: float = 1.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and the maximal segments in tokens."""
        words = words_of(text)
        if self.scores.keys().isdisjoint(words):
            return len(words), []
        places = [k for k, w in enumerate(words) if w in self.scores]
        return len(words), segments(places, [self.scores[words[k]] for k in places], self.rest)

    def expected(self, n: int, score: float) -> float:
        """How many segments of this score ``n`` clean tokens have on average."""
        return self.density * max(n, 1) * float(np.exp(-self.scale * score))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return sum(max(0.0, -float(np.log(max(self.expected(n, s), 1e-300)))) for _, _, s in found)

    def curve(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.shift, -30, 30)))

    def scored(self, text: str) -> tuple[float, list[dict]]:
        """The score of a text and its significant passages, in characters."""
        n, found = self.passages(text)
        score = float(self.curve(np.array([self.evidence(n, found)]))[0])
        found = [x for x in found if self.expected(n, x[2]) < SIGNIFICANT]
        if not found:
            return score, []
        spans = [m.span() for m in WORD.finditer(lowered(text))]
        return score, [{"start": spans[a][0], "end": spans[b][1], "score": s, "expected": self.expected(n, s)} for a, b, s in found]


def labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, rows: int) -> DataFrame:
    """A written table of ``y`` and text ``t`` of at most ``rows`` labelled documents."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"), F.count("y").alias("n"), F.count("*").alias("m"))
    known = known.filter("y = z AND n = m AND y IN (0, 1)").select("id", "y", F.xxhash64("id").alias("h"))
    chosen = known.orderBy("h", "id").limit(rows)  # so many rows at most, so they may be sent to all tasks
    have = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("t")).join(F.broadcast(chosen), "id")
    return written(have.select("y", "t"), "labelled")


INCIDENCE = StructType().add("word", "string").add("place", "long").add("toxic", "integer")
COUNTED = StructType().add("word", "string").add("n", "long")


def incidence(have: DataFrame) -> DataFrame:
    """``word``, ``place`` (the least hash of its neighbourhoods) and ``toxic`` of each different word of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = words_of(t)
                least: dict[str, int] = {}
                for k, w in enumerate(words):
                    h = xxhash.xxh64_intdigest(" ".join(words[max(k - 1, 0) : k + 2])) >> 1
                    if least.get(w, h) >= h:
                        least[w] = h
                items = list(least.items())
                for a in range(0, len(items), AT_ONCE):
                    some = items[a : a + AT_ONCE]
                    yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in some], pa.string()), "place": pa.array([h for _, h in some], pa.int64()), "toxic": pa.array([y] * len(some), pa.int32())})

    return have.select("y", "t").mapInArrow(run, INCIDENCE)


def document_counts(docs: DataFrame, text: str, wanted: list[str]) -> dict[str, int]:
    """In how many of all documents each wanted word stands; under "" how many different words all documents have together."""
    bounded_batches(docs.sparkSession)
    chosen = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column("t").to_pylist():
                different = set(words_of(t))
                counts[""] += len(different)
                counts.update(different & chosen)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    found = docs.select(text_or_empty(text).alias("t")).mapInArrow(run, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def proof(c_toxic: np.ndarray, c_clean: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """The signed root of twice the log-likelihood ratio of two rates against a common one."""
    share = toxic / (toxic + clean)
    both = c_toxic + c_clean
    part = lambda c, e: np.where(c > 0, c * np.log(np.maximum(c, 1) / e), 0.0)
    ratio = part(c_toxic, both * share) + part(c_clean, both * (1 - share))
    return np.sign(c_toxic / toxic - c_clean / clean) * np.sqrt(2 * np.maximum(ratio, 0))


def root_scale(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive number at which the clean tokens' mean of ``exp(number * score)`` is 1."""
    mean = lambda x: float(np.dot(shares, np.exp(np.minimum(x * scores, 700))))
    low, high = 1e-3, 1.0
    while mean(high) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learn from ``labels`` (``doc_id``, ``label`` 0 or 1) of ``docs``; at most ``rows`` labelled rows are used."""
    bounded_batches(docs.sparkSession)
    have = labelled(docs, labels, text, doc_id, label, rows)
    kinds = {r["y"]: r["n"] for r in have.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(1) or not kinds.get(0):
        return Model(constant=1.0 if kinds.get(1) else 0.0)
    each = incidence(have).groupBy("word", "place").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    each = written(each.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "incidence")
    toxic, clean = each.agg(F.sum("t"), F.sum("c")).first()
    if not toxic or not clean:
        return Model(constant=0.0)
    often = each.filter(F.col("t") >= DOCUMENTS)  # words of a bounded number of rows
    often = often.filter(F.col("t") / F.lit(toxic) > F.col("c") / F.lit(clean)).orderBy("word").toArrow()
    words = np.array(often["word"].to_pylist(), object)
    c_toxic, c_clean = (np.array(often[k].to_pylist(), np.float64) for k in ("t", "c"))
    chosen = proof(c_toxic, c_clean, toxic, clean) >= PROOF
    if not chosen.any():
        return Model(constant=0.0)
    words, c_toxic, c_clean = words[chosen], c_toxic[chosen], c_clean[chosen]
    counts = document_counts(docs, text, words.tolist())
    weight = PRIOR * (toxic + clean)
    prior = weight * np.array([max(counts.get(w, 0), 1) for w in words], np.float64) / max(counts.get("", 0), 1)
    p_toxic, p_clean = (c_toxic + prior) / (toxic + weight), (c_clean + prior) / (clean + weight)
    scores = np.log(p_toxic / p_clean)
    rest = float(np.log((1 - p_toxic.sum()) / (1 - p_clean.sum())))
    rest = min(rest, -1e-6)
    model = Model({w: float(s) for w, s in zip(words, scores, strict=True) if s > 0}, rest)
    model.scale = root_scale(np.append(scores, rest), np.append(p_clean, 1 - p_clean.sum()))
    return calibrated(model, have)


def calibrated(model: Model, have: DataFrame) -> Model:
    """``model`` with the density of chance segments and the curve, from the labelled documents."""

    def start():
        def batch(texts: list[str]) -> pa.Array:
            found = [model.passages(t) for t in texts]
            return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64()))], names=["n", "s"])

        return batch

    kind = StructType([StructField("n", LongType()), StructField("s", ArrayType(DoubleType()))])
    rows = have.select("y", arrow_column(have, start, kind, F.col("t")).alias("f")).select("y", "f.n", "f.s").orderBy("y", "n", "s").collect()
    tokens, sizes = 1.0, 0.0
    for r in rows:
        if r["y"] == 0:  # the density under which the greatest segments of the clean documents are likeliest
            tokens += 1.0
            sizes += max(r["n"], 1) * float(np.exp(-model.scale * max(r["s"], default=0.0)))
    model.density = min(1.0, tokens / max(sizes, 1.0))
    x = np.log1p([model.evidence(r["n"], [(0, 0, s) for s in r["s"]]) for r in rows])
    y = np.array([r["y"] for r in rows], np.float64)
    w = np.zeros(2)
    inputs = np.stack([x, np.ones(len(x))], 1)
    for _ in range(30):  # Newton's method, with a little weight against extremes
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        w += np.linalg.solve((inputs * (p * (1 - p) + 1e-6)[:, None]).T @ inputs + 0.1 * np.eye(2), inputs.T @ (y - p) - 0.1 * w)
    model.slope = max(float(w[0]), 1e-3)
    model.shift = float(np.log(TOXIC / (1 - TOXIC))) - best_cut(model.slope * x, y)
    return model


def with_score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``passages`` (begin and end in characters, score, expected number among clean texts) of each whole text."""

    def start():
        def batch(texts: list[str]) -> pa.Array:
            found = [model.scored(t) for t in texts]
            passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
            return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.array([p for _, p in found], pa.list_(passage))], names=["score", "passages"])

        return batch

    return with_fields(df, arrow_column(df, start, SCORED, text_or_empty(text)), SCORED)
