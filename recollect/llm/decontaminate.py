"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search.

A short test item is *contained* in a document if at least ``SIMILARITY`` of the item's distinct shingles occur in it; the
document's own length doesn't matter.  Shingles are of five words; an item of one to four words is one shingle of all its words, which
is looked for among the document's sequences of that many words.

Items are partitioned by size: by their number of words up to four, and by the power of two of their number of shingles beyond.  A class of
size has its own width of shingles, its own length of sketches and its own bound on documents:

* for an item of n shingles at least m = ceil(0.8 n) must occur, so of any n - m + 1 of them at least one does: a sketch of that
  many least values under one fixed order is enough to find every document, at any document length, without a miss;
* a document of fewer shingles than the m of the smallest item of a class can't contain any item of it, and doesn't probe it.

The order is by how many items share a shingle and then by hash, so wording that many items share is rarely a key.  Documents are probed
with all their shingles of the widths that occur among the items; what is found is verified by exact containment of the shingles' texts.

Words are maximal runs of letters and digits of the lower-case text.  A text without words has no shingle and neither contains
nor is contained.

DataFrame functions only.  The items' sketches and the found pairs are sent to all tasks only while counted to be small.

Defined results: null texts count as empty; null ids are kept; repeated rows and items are matched each; other columns
don't matter; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sent, text_or_empty, written

WORDS = 5
SIMILARITY = 0.8


def words(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[^\\p{L}\\p{N}]+"))


def shingles(w: Column, width: int, make) -> Column:
    """``make(list of columns)`` of each ``width`` words in a row."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: make([F.get(w, i + k) for k in range(width)]))
    return F.when(F.size(w) >= width, each).otherwise(F.array())


def hashes(w: Column, width: int) -> Column:
    return shingles(w, width, lambda c: F.xxhash64(F.lit(width), *c))


def texts(w: Column, width: int) -> Column:
    return shingles(w, width, lambda c: F.concat_ws(" ", *c))


def by_width(w: Column, width: Column, widths: list[int], make) -> Column:
    """``make(w, width)`` for that of the ``widths`` which the column ``width`` has."""
    out = F.lit(None)
    for k in widths:
        out = F.when(width == k, make(w, k)).otherwise(out)
    return out


def needed(n: Column, similarity: float) -> Column:
    return F.ceil(F.round(F.lit(similarity) * n, 9)).cast("int")


def sketches(items: DataFrame, similarity: float, widths: list[int]) -> DataFrame:
    """``item``, ``key``, ``size_class`` and ``least`` (shingles that a document needs for an item of the class): each item's least shingles."""
    own = items.select("item", "width", "w").withColumn("h", F.array_distinct(by_width(F.col("w"), F.col("width"), widths, hashes)))
    own = own.select("item", "width", F.size("h").alias("n"), F.explode("h").alias("h"))
    ordered = own.join(own.groupBy("h").agg(F.count("*").alias("shared")), "h").groupBy("item", "width", "n")
    ordered = ordered.agg(F.array_sort(F.collect_list(F.struct("shared", "h"))).alias("o"))  # bounded by the item's length
    # classes 1 to 4 are items of that many words, 5 and more those of 1, 2, 4, ... shingles of five
    size_class = F.when(F.col("width") < WORDS, F.col("width")).otherwise(WORDS + F.floor(F.log2("n")).cast("int"))
    smallest = F.when(F.col("size_class") < WORDS, 1).otherwise(F.pow(F.lit(2.0), F.col("size_class") - WORDS))
    size = F.col("n") - needed(F.col("n"), similarity) + 1
    return ordered.select("item", size_class.alias("size_class"), F.explode(F.slice("o", F.lit(1), size)["h"]).alias("key")).withColumn(
        "least", needed(smallest, similarity)
    )


def row_key(doc_id: str, text: str) -> Column:
    """A hash of a document that is the same at each reading; equal rows have equal results, so they may share it."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text_or_empty(text))


def contained(
    docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shared``, ``n_item``, ``containment`` and ``row_key`` of each document and each item it contains."""
    bench = items.select(F.col(item_id).alias("item_id"), words(text_or_empty(item_text)).alias("w")).filter(F.size("w") > 0)
    bench = written(bench.withColumn("item", F.monotonically_increasing_id()).withColumn("width", F.least(F.size("w"), F.lit(WORDS))), "items")
    widths = sorted(r.width for r in bench.select("width").distinct().collect()) or [WORDS]  # five at most
    keys = sent(written(sketches(bench, similarity, widths).select("item", "key", "least"), "sketches"))
    base = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), row_key(doc_id, text).alias("row_key"))
    # the words are a column of their own: an expression would be evaluated anew for each shingle
    split = base.select("row_key", words(F.col("text")).alias("w"))
    shingled = F.concat(*[hashes(F.col("w"), k) for k in widths])
    probes = split.select("row_key", F.size("w").alias("size"), F.explode(shingled).alias("key"))
    # as many shingles of five words as words, less four; an item of fewer words needs one shingle, which has been found
    enough = (keys["least"] == 1) | (keys["least"] <= probes["size"] - (WORDS - 1))
    found = written(probes.join(keys, (probes["key"] == keys["key"]) & enough).select("row_key", "item").distinct(), "candidates")
    pairs = base.join(sent(found), "row_key").select("doc_id", "row_key", "item", words(F.col("text")).alias("w"))
    wanted = bench.select("item", "item_id", "width", F.array_distinct(by_width(F.col("w"), F.col("width"), widths, texts)).alias("wanted"))
    pairs = pairs.join(sent(written(wanted, "wanted")), "item")
    shared = F.size(F.array_intersect("wanted", by_width(F.col("w"), F.col("width"), widths, texts)))
    checked = pairs.select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.size("wanted").cast("long").alias("n_item"), "row_key")
    checked = checked.filter(F.col("n_shared") >= needed(F.col("n_item"), similarity))
    return checked.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"), "row_key")


def decontaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    bad = written(contained(docs, items, similarity, doc_id, text, **names).select("row_key").distinct(), "contaminated")
    key = row_key(doc_id, text)
    return docs.join(sent(bad.withColumnRenamed("row_key", "__contaminated")), key == F.col("__contaminated"), "left_anti")
