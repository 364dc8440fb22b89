"""Operator 6: near duplicates by SimHash, found with Golay-code fuzzy hashing.

A fingerprint has 64 bits, each the majority of that bit over the hashes of the text's word shingles.  Fingerprints that differ in
at most 3 bits are linked, and documents belong together if a chain of links joins them.

Links are found among the distinct fingerprints.  A fingerprint is cut into segments A and B of 23 bits and C of 18.  The binary
Golay code of length 23 is perfect: each 23-bit word lies within 3 bits of exactly one of 4096 codewords, its *index*.  The indices
of a segment and of its neighbours at 1 bit (six different ones mostly, fewer if the segment is close to a codeword) contain the
index of every word at 1 bit or none, so they are keys that tolerate one error.  Of at most 3 errors in A, B and C,

* A and B have at most one each: key (index A, index B); or else
* A has two or three, so B and C share at most one: key (B, index C) or (index B, C); or
* B has two or three, so A and C share at most one: key (A, index C) or (index A, C).

So of two linked fingerprints one has the other's *point* (its own indices) among its *probes* (all indices): joining probes with
points on the key and checking the distance finds each link, and nothing else passes.  A key that very many distinct fingerprints
share is refined: of six blocks of bits at least three hold no error, so each choice of three blocks extends the key, which again
misses nothing.  Copies are one fingerprint, so their number plays no part.

``near_copies`` finds the groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.  Texts that differ in white space and
case alone are one class from the start.  First links join most of a group: the texts of each key, and those that share a few least shingles under
``ROUNDS`` orders of them, are compared with the least and the greatest of them only.  The keys are those above, of ``TABLES`` fingerprints of a text's
words, each weighted by the root of its number.  These links may miss any pair; what they haven't joined is then found exactly (``apart_yet``).  Sets of n
shingles have a similarity of s with no set that shares none of their n - ceil(s n) + 1 least hashes, their *prefix*.  So texts of different groups
meet in each hash that their prefixes share, and those are left whose sets can be alike by their sizes, by what can still be shared after that hash, and by
their parities: each shingle flips one of ``PARITIES`` bits, so two sets differ in as many shingles at least as their parities in bits, and sets
of a Jaccard similarity s differ in (1 - s) / (1 + s) of their sizes' sum at most.  No link fails this, and of a family of texts that are alike
but not enough hardly a pair passes.  Larger sets would fill the parities, so they are cut into 2, 4, ... ranges of hashes (``segments``) until these have about
``SEGMENT`` hashes at most: if all ranges differed in more than that part, so would the sets, so similar sets are similar in one range at least.  A set takes
each number of ranges that a similar smaller set may have.  What is linked is verified by the shingles themselves.  So a group of very many near copies isn't compared pair by pair, and no link between groups is lost.

Defined results: a null text counts as an empty one; a text without words has fingerprint zero; texts of fewer words than a shingle
are one shingle; repeated rows are linked like any others; a null doc_id is ignored as a component's least id unless it is the only
one; an empty table gives an empty one; columns named ``fingerprint`` or ``component_id`` in the input are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructType, VariantType

from .components import components
from .shared import arrow_column, by_place, place_of, sent, text_or_empty, written

WORDS, SEED, RADIUS = 3, 42, 3
#: Near copies: words of a shingle, least similarity, and fingerprints of a text's words for first links.
SHINGLE, SIMILARITY, TABLES = 5, 0.8, 4
#: Bits in which fingerprints of the shingles differ at most where a first link is tried (ten on average at a similarity of 0.8).
SPREAD = 18
#: Parity bits of a set of shingles, and the size up to which a set has them (larger ones would fill the bits).
PARITIES, PARITY_SIZE = 256, 512
#: Rounds of first links by least shingles, and how many of them texts must share in a round.
ROUNDS, SHARED = 8, 5
#: Hashes of a range of a set at most, on average.
SEGMENT = 256
#: Words whose hashes are kept in memory, and the longest of them.
KEPT_WORDS, KEPT_BYTES = 150_000, 40
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
AT_ONCE = 1 << 15
#: A key of more points than this is refined.
CROWDED = 1000

#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value of the code).
GENERATOR = 0b110001110101


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit integer."""
    parts = words_of(text)
    if not parts:
        return 0
    if len(parts) <= words:
        value = xxhash.xxh64_intdigest(b" ".join(parts), SEED)
        return value - (1 << 64) if value >> 63 else value
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(parts) - words + 1
    for a in range(0, n, AT_ONCE):
        b = min(n, a + AT_ONCE)
        spans = zip(begins[a:b].tolist(), ends[a + words - 1 : b + words - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[x:y], SEED) for x, y in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    start = lambda: lambda texts: pa.array(map(fingerprint, texts), pa.int64())
    return df.withColumn(name, arrow_column(df, start, LongType(), text_or_empty(text)))


@lru_cache(maxsize=1)
def golay_index() -> np.ndarray:
    """Of each 23-bit word the index of the one codeword within 3 bits."""
    codewords = np.zeros(1, np.int64)
    for k in range(12):  # sums of the shifted generator
        codewords = np.concatenate([codewords, codewords ^ (GENERATOR << k)])
    table = np.empty(1 << 23, np.uint16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            table[codewords ^ sum(1 << b for b in bits)] = np.arange(4096)
    return table


def segments(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = prints.view(np.uint64)
    cut = lambda shift, bits: (u >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return cut(0, 23), cut(23, 23), cut(46, 18)


def tolerant(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each word and its neighbours at one bit, sorted, and which of them are the first of their kind."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
    found = np.sort(golay_index()[segment[:, None] ^ flips].astype(np.int64), axis=1)
    return found, np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)


def keys_of(prints: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the place of each key's fingerprint: all probes, or the five points."""
    a, b, c = segments(prints)
    places, keys, all_places = np.arange(len(prints)), [], []

    def add(family: int, own: np.ndarray, key: np.ndarray) -> None:
        keys.append(key | family << 48)
        all_places.append(own)

    if not probes:
        index = golay_index()
        ia, ib, ic = (index[s].astype(np.int64) for s in (a, b, c))
        for family, key in enumerate((ia << 12 | ib, b << 12 | ic, c << 12 | ib, a << 12 | ic, c << 12 | ia)):
            add(family, places, key)
        return np.concatenate(keys), np.concatenate(all_places)
    (fa, na), (fb, nb), (fc, nc) = tolerant(a, 23), tolerant(b, 23), tolerant(c, 18)
    for k in range(fa.shape[1]):  # one index of A at a time, so that memory stays linear
        own = np.flatnonzero(na[:, k])
        row, column = np.nonzero(nb[own])
        add(0, own[row], fa[own[row], k] << 12 | fb[own[row], column])
    for family, exact, (found, new) in ((1, b, (fc, nc)), (2, c, (fb, nb)), (3, a, (fc, nc)), (4, c, (fa, na))):
        row, column = np.nonzero(new)
        add(family, row, exact[row] << 12 | found[row, column])
    return np.concatenate(keys), np.concatenate(all_places)


KEYED = StructType().add("key", "long").add("fp", "long")
PARITY = [f"parity{k}" for k in range(PARITIES // 64)]
TEXTS = StructType().add("key", "long").add("kind", "integer").add("fp", "long").add("node", "long")


def keyed(prints: DataFrame, probes: bool) -> DataFrame:
    """``key`` and ``fp`` of a table of distinct fingerprints ``fp``; the columns of ``TEXTS`` if it has them, keys of different kinds apart."""
    kind = TEXTS if "kind" in prints.columns else KEYED
    names = kind.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, places = keys_of(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64), probes)
                rest = {n: batch.column(n).take(pa.array(places)) for n in names}
                if "kind" in rest:
                    keys = keys | rest["kind"].to_numpy().astype(np.int64) << 56
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys)} | rest)

    return prints.select(names).mapInArrow(run, kind)


def refining(fp: Column, key: Column) -> Column:
    """For each choice of three of six blocks of bits a key that also has those blocks."""
    edges = [round(64 * i / 6) for i in range(7)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(6)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(blocks[i] for i in chosen)) for chosen in combinations(range(6), 3)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: F.xxhash64(key, m, fp.bitwiseAND(m)))


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``a`` and ``b`` of the distinct fingerprints ``fp`` that differ in at most 3 bits."""
    close = lambda p, q: (p["fp"] < q["fp"]) & (F.bit_count(p["fp"].bitwiseXOR(q["fp"])) <= RADIUS)
    return met(prints, close, "fp", crowded)


def met(prints: DataFrame, close: Callable[[DataFrame, DataFrame], Column], node: str, crowded: int = CROWDED) -> DataFrame:
    """``a`` and ``b``, the ``node`` of two rows that share a key and are ``close``.

    A probe finds each point within one error of it in its segments, in either order of the two.
    """
    probes, points = keyed(prints, True), keyed(prints, False)
    full = written(points.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("key"), "crowded")

    def near(probes: DataFrame, points: DataFrame) -> DataFrame:
        p, q = (df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side, df in (("p", probes), ("q", points)))
        columns = lambda side: {c: F.col(f"{side}_{c}") for c in probes.columns}
        return p.join(q, (F.col("p_key") == F.col("q_key")) & close(columns("p"), columns("q"))).select(F.col(f"p_{node}").alias("a"), F.col(f"q_{node}").alias("b"))

    if not full.take(1):
        return near(probes, points).distinct()
    rest = [c for c in probes.columns if c != "key"]
    refined = lambda df: df.join(full, "key", "left_semi").select(F.explode(refining(F.col("fp"), F.col("key"))).alias("key"), *rest)
    alone = lambda df: df.join(full, "key", "left_anti")
    return near(alone(probes), alone(points)).unionByName(near(refined(probes), refined(points))).distinct()


def fingerprinted(df: DataFrame, text: str, doc_id: str, keep: list[str]) -> DataFrame:
    """A written table of the columns ``keep``, ``__id``, ``fingerprint`` and ``row`` (a number of its own for each row)."""
    rows = with_fingerprint(df, text).select(*[F.col(f"`{c}`") for c in keep], F.col(doc_id).alias("__id"), "fingerprint")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")


def named(rows: DataFrame) -> DataFrame:
    """Each ``fingerprint`` of ``rows`` with its ``component_id`` and ``root`` (the component's least fingerprint)."""
    prints = written(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("__id").alias("least")), "prints")
    roots = components(links(prints))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    # grouped by one more (dependent) column, so that the join shuffles both sides and a large component can be split
    groups = rooted.groupBy("root", F.hash("root").alias("apart")).agg(F.min("least").alias("component_id")).drop("apart")
    return rooted.join(groups, "root").select(F.col("fp").alias("fingerprint"), "component_id", "root")


def grouped(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` with ``fingerprint``, ``component_id``, ``root`` and ``row``."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("fingerprint", "component_id", "root", "row")]
    rows = fingerprinted(df, text, doc_id, keep)
    return rows.join(named(rows), "fingerprint").select(*[F.col(f"`{c}`") for c in keep], "fingerprint", "component_id", "root", "row")


SEGMENTS = ArrayType(StructType().add("size", "integer").add("parity", ArrayType(LongType())).add("prefix", ArrayType(LongType())))
PRINTS = StructType().add("class", "binary").add("prints", ArrayType(LongType())).add("spread", "long").add("shingles", "integer").add("size", "integer").add("parity", ArrayType(LongType())).add("rounds", ArrayType(LongType())).add("segments", SEGMENTS)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII alone


def word_prints(parts: list[bytes], kept: dict[bytes, bytes]) -> list[int]:
    """``TABLES`` fingerprints of words, each weighted by the root of its number; ``kept`` remembers hashes."""
    counts, sums = Counter(parts), np.zeros(64 * TABLES)
    different, weights = list(counts), np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    for a in range(0, len(different), AT_ONCE // 8):
        some = different[a : a + AT_ONCE // 8]
        hashes = []
        for w in some:
            h = kept.get(w)
            if h is None:
                h = b"".join(xxhash.xxh3_128_digest(w, SEED + k) for k in range(TABLES // 2))
                if len(kept) < KEPT_WORDS and len(w) <= KEPT_BYTES:
                    kept[w] = h
            hashes.append(h)
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(len(some), 8 * TABLES), axis=1)
        own = weights[a : a + len(some)]
        sums += 2 * (own @ bits.astype(np.float32)) - own.sum()
    return np.packbits(np.round(sums, 3) > 0).view(np.int64).tolist()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of the ``SHINGLE``-word shingles, repeats included; of all words together if they are fewer."""
    n = max(len(words) - SHINGLE + 1, min(len(words), 1))
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + SHINGLE]), SEED) for k in range(n)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes, as ``fingerprint`` has it of a text's."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), AT_ONCE):
        ones += np.unpackbits(hashes[a : a + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def parities(hashes: np.ndarray) -> list[int] | None:
    """Bits that each tell whether an odd number of a set's hashes belongs to them; none for a large set."""
    if len(hashes) > PARITY_SIZE:
        return None
    odd = (np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


#: Odd factors, each of which puts hashes into an order of its own.
ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, ROUNDS * SHARED).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def rounds(hashes: np.ndarray) -> list[int]:
    """For each round a hash of the least shingles under its orders."""
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), AT_ONCE // 8):
        least = np.minimum(least, (hashes[a : a + AT_ONCE // 8, None] * ORDERS).min(0))
    return [xxhash.xxh64_intdigest(part.tobytes(), k) - (1 << 63) for k, part in enumerate(least.reshape(ROUNDS, SHARED))]


def prefix(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The least of a set's ascending hashes, of which it shares one at least with each set that is similar."""
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-4) + 1]


def halvings(size: int) -> int:
    """How often the range of hashes is halved for a set of this size."""
    return max(0, ((size - 1) // SEGMENT).bit_length())


def segments_of(hashes: np.ndarray, similarity: float) -> Iterator[tuple[int, list[int] | None, np.ndarray]]:
    """Size, parities and prefix of each range of a set's ascending hashes that has any; hashes of different numbers of ranges are told apart."""
    least = math.ceil(similarity * len(hashes) - 1e-4)
    for k in range(halvings(least), halvings(len(hashes)) + 1) if len(hashes) else ():
        bounds = np.arange(1, 1 << k, dtype=np.uint64) << np.uint64(64 - k) if k else np.empty(0, np.uint64)
        for part in np.split(hashes, np.searchsorted(hashes, bounds)):
            if len(part):
                yield len(part), parities(part), prefix(part, similarity) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def segments_column(sets: list[np.ndarray], similarity: float) -> pa.Array:
    each = [list(segments_of(h, similarity)) for h in sets]
    flat = [x for own in each for x in own]
    starts = lambda lengths: pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    hashes = np.concatenate([x[2] for x in flat]).view(np.int64) if flat else np.empty(0, np.int64)
    fields = [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.list_(pa.int64())), pa.ListArray.from_arrays(starts([len(x[2]) for x in flat]), pa.array(hashes))]
    return pa.ListArray.from_arrays(starts([len(own) for own in each]), pa.StructArray.from_arrays(fields, names=["size", "parity", "prefix"]))


def classed(df: DataFrame, text: str, similarity: float = SIMILARITY) -> Column:
    """The class of a text (a hash of its words), the fingerprints of its words and shingles, and of its set of shingles size, parities, rounds and segments."""

    def start():
        kept: dict[bytes, bytes] = {}

        def batch(texts: list[str]) -> pa.Array:
            words = [words_of(t) for t in texts]
            hashes = [shingle_hashes(w) for w in words]
            sets = [np.unique(h) for h in hashes]
            columns = [
                pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                pa.array([word_prints(w, kept) for w in words], pa.list_(pa.int64())),
                pa.array([majority(h) for h in hashes], pa.int64()),
                pa.array([len(h) for h in hashes], pa.int32()),
                pa.array([len(h) for h in sets], pa.int32()),
                pa.array([parities(h) for h in sets], pa.list_(pa.int64())),
                pa.array([rounds(h) for h in sets], pa.list_(pa.int64())),
                segments_column(sets, similarity),
            ]
            return pa.StructArray.from_arrays(columns, names=PRINTS.names)

        return batch

    return arrow_column(df, start, PRINTS, text_or_empty(text))


def shingle_sets(df: DataFrame, text: str) -> Column:
    """The different hashes of a text's shingles."""
    one = lambda t: np.unique(shingle_hashes(words_of(t))).view(np.int64).tolist()
    return arrow_column(df, lambda: lambda texts: pa.array(map(one, texts), pa.list_(pa.int64())), ArrayType(LongType()), text_or_empty(text))


def may_be_alike(p: dict[str, Column], q: dict[str, Column], similarity: float) -> Column:
    """Whether two sets of shingles can have this similarity, by their sizes and, where both have them, parities.  It holds for all that have it."""
    differing = sum((F.bit_count(p[c].bitwiseXOR(q[c])) for c in PARITY[1:]), F.bit_count(p[PARITY[0]].bitwiseXOR(q[PARITY[0]])))
    little = differing * (1 + similarity) <= (p["size"] + q["size"]) * (1 - similarity) + 1e-6
    sizes = F.least(p["size"], q["size"]) >= F.greatest(p["size"], q["size"]) * similarity - 1e-6
    return sizes & F.coalesce(little, F.lit(True))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those ``pairs`` (``a``, ``b``) of nodes whose ``shingles`` in ``sets`` (by ``node``) are similar."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return both.filter((shared > 0) & (F.round(shared / union, 9) >= similarity)).select("a", "b")


def apart_yet(rows: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``a`` and ``b`` of all ``texts`` of different ``roots`` that may be similar: all that are similar are among them.

    Each text's segments are read where they were written, in that of ``rows`` whose ``row`` is its ``node``.
    """
    rooted = texts.join(roots, texts["node"] == roots["of"], "left").select("node", "size", F.coalesce("root", "node").alias("root"))
    rooted = sent(written(rooted, "rooted"))
    each = rows.join(rooted.withColumnRenamed("size", "whole"), F.col("row") == F.col("node")).select("node", "root", "whole", F.posexplode("segments").alias("segment", "s"))
    held = each.select("node", "root", "segment", F.posexplode("s.prefix").alias("pos", "key"))
    # one shuffle of the hashes, and none of them written beside it
    same = Window.partitionBy("key")
    held = held.withColumn("low", F.min("root").over(same)).withColumn("high", F.max("root").over(same)).filter("low <> high").drop("low", "high")
    # a range's size is within a step of that of a similar one
    step = max(-math.log(similarity), 1e-3) * (1 + 1e-6)
    # the sketches of ranges don't go with every hash, but meet those that are left
    sketch = [F.col("s.size").alias("size"), F.floor(F.log("s.size") / step).cast("int").alias("step"), *[F.get("s.parity", k).alias(c) for k, c in enumerate(PARITY)]]
    own = each.select("node", "segment", "whole", *sketch)
    held = written(held.join(own, ["node", "segment"]).drop("segment"), "bridging")
    p, q = (held.select([F.col(c).alias(f"{side}_{c}") for c in held.columns]) for side in "pq")
    p = p.withColumn("p_step", F.explode(F.array("p_step", F.col("p_step") + 1)))
    x, y = ({c: F.col(f"{side}_{c}") for c in held.columns} for side in "pq")
    ordered = (x["size"] < y["size"]) | ((x["size"] == y["size"]) & (x["node"] < y["node"]))
    wholes = F.least(x["whole"], y["whole"]) >= F.greatest(x["whole"], y["whole"]) * similarity - 1e-4
    # what two ranges can share from this hash on, if it is the first that they share
    left = F.least(x["size"] - x["pos"], y["size"] - y["pos"]) >= (x["size"] + y["size"]) * (similarity / (1 + similarity)) - 1e-3
    meet = (x["key"] == y["key"]) & (x["step"] == y["step"]) & (x["root"] != y["root"]) & ordered & left & wholes & may_be_alike(x, y, similarity)
    return p.join(q, meet).select(F.least("p_node", "q_node").alias("a"), F.greatest("p_node", "q_node").alias("b")).distinct()


def near_copies(rows: DataFrame, docs: DataFrame, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """``class`` and ``group``, a number that the classes of a group share, of all classes that have words.

    ``rows`` has a number (``row``), the ``class``, number of ``shingles`` and sketches (``classed``, with the same similarity) of each row of ``docs``, and both have the keys
    ``__k1`` and ``__k2``.  A class is known by one of its rows, its ``node``; segments, the greater part of ``rows``, stay where they are.
    """
    ones = F.min(F.struct(F.col("row").alias("node"), "__k1", "__k2")).alias("k")  # one row of each class: all of a class have the same shingles
    same = [F.first(c).alias(c) for c in ("prints", "spread", "size", "parity", "rounds")]
    texts = rows.filter("shingles > 0").groupBy("class").agg(*same, ones)
    texts = written(texts.select("class", "prints", "rounds", "spread", "size", *[F.get("parity", k).alias(c) for k, c in enumerate(PARITY)], "k.*"), "texts")
    sketch = ["spread", "size", *PARITY]

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = texts.join(wanted, "node", "left_semi").select("node", "__k1", "__k2")
        own = docs.select("__k1", "__k2", F.col(text).alias("t")).join(sent(written(wanted, "wanted")), ["__k1", "__k2"])
        return written(own.select("node", shingle_sets(own, "t").alias("shingles")).groupBy("node").agg(F.first("shingles").alias("shingles")), name)

    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    # the texts of each key with the least and the greatest of them; sketches join the different pairs, not each key
    points = keyed(texts.select("node", F.posexplode("prints").alias("kind", "fp")), False).select("key", "node")
    points = written(points.unionByName(texts.select(F.explode("rounds").alias("key"), "node")), "points")
    ends = points.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    stars = points.join(ends, "key").select("node", F.explode(F.array("least", "most")).alias("first")).filter("node <> first")
    stars = stars.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()
    for side in "ab":
        stars = stars.join(texts.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sketch]), side)
    own, first = ({c: F.col(f"{side}_{c}") for c in sketch} for side in "ab")
    near = (apart(own["spread"], first["spread"]) <= SPREAD) & may_be_alike(own, first, similarity)
    stars = written(stars.filter(near).select("a", "b"), "stars")
    sure = written(verified(stars, sets_of(stars, "sets"), similarity), "sure")
    roots = written(components(sure).withColumnRenamed("node", "of"), "roots")
    more = written(apart_yet(rows, texts, roots, similarity), "more")
    late = written(verified(more, sets_of(more, "late_sets"), similarity), "late")
    roots = components(sure.unionByName(late)).withColumnRenamed("node", "of")
    return texts.select("class", "node").join(roots, F.col("node") == F.col("of"), "left").select("class", F.coalesce("root", "node").alias("group"))


def deduplicated(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each group of near copies: that of the least doc_id (null last).

    Of rows equal in id and text that with the least hash of its other columns stays.  Groups are found on ids, hashes and fingerprints.
    The rows to remove are looked up by two hashes of id and text, so whole rows are only read, and shuffled only when those to remove are
    too many to be sent to all tasks.
    """
    own, body, base = place_of(df, doc_id), text_or_empty(place_of(df, text)), by_place(df)
    shown = F.coalesce(F.col(own).cast("string"), F.lit("null"))
    plain = [f.name for f in base.schema if not isinstance(f.dataType, MapType | VariantType)]
    keys = {"__k1": F.xxhash64(shown, body), "__k2": F.xxhash64(body, F.lit("/"), shown)}
    hashed = base.withColumns(keys | {"__k3": F.xxhash64(*plain)})
    rows = hashed.withColumn("__p", classed(base, place_of(df, text), similarity)).select(*keys, "__k3", F.col(own).alias("__id"), "__p.*")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    roots = near_copies(rows, hashed, place_of(df, text), similarity)
    # equal rows first, then the rows of a class, then those of a group: few of any group reach the next step.  The joins have
    # shuffles of their own on both sides, so that the rows of one class or group can be split over tasks.
    rank = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "__k1", "__k2")
    each = rows.groupBy("class", "__id", *keys).agg(F.count("*").alias("n"), F.min("__k3").alias("k3"))
    # texts without words are one class, which has no group of its own
    each = each.join(roots, "class", "left").withColumn("root", F.coalesce("group", F.lit(-1).cast("long")))
    each = written(each.withColumn("rank", rank).drop("__id", "group"), "each")
    first = each.groupBy("root", "class").agg(F.min("rank").alias("least"), F.count("*").alias("m"))
    first = first.groupBy("root", F.hash("root").alias("apart")).agg(F.min("least").alias("least"), F.sum("m").alias("m")).filter("m > 1").select("root", "least")
    gone = written(each.join(first, "root").filter(F.col("rank") != F.col("least")).select(*keys), "gone")
    twice = written(each.filter("n > 1").select(*keys, "k3"), "twice")
    kept = hashed.join(sent(gone), list(keys), "left_anti")
    if twice.take(1):
        again = kept.join(sent(twice), list(keys)).filter(F.col("__k3") == F.col("k3")).drop("k3").dropDuplicates(list(keys))
        kept = kept.join(sent(twice.drop("k3")), list(keys), "left_anti").unionByName(again)
    return kept.drop(*keys, "__k3").toDF(*df.columns)
