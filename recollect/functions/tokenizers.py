"""The tokenizers of the text encoders, as Arrow-batched functions (STR-j, STR-l)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the two encoders: frame tokens, lengths, the token of unknown words.
START, END, LENGTH = 49406, 49407, 77
CLS, SEP, UNKNOWN, PIECES, LONGEST = 101, 102, 100, 64, 100


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """A word's symbols after merging, again and again, the pair of the least rank wherever it stands."""
    parts = [*word[:-1], word[-1] + "</w>"] if word else []
    while len(parts) > 1:
        rank, pair = min((ranks.get(p, len(ranks)), p) for p in zip(parts, parts[1:], strict=False))
        if rank == len(ranks):
            break
        out: list[str] = []
        for symbol in parts:
            if out and (out[-1], symbol) == pair:
                out[-1] += symbol + "\0"  # closed: the next symbol starts anew
            else:
                out.append(symbol)
        parts = [p.rstrip("\0") for p in out]
    return parts


def ranked(merges: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """The place of each merge in its list; of equal ones the first."""
    return {p: k for k, p in reversed([*enumerate(merges)])}


def first_merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """A word's letters after applying, again and again, the first merge of the list that fits, at its first place (STR-k)."""
    parts = [*word]
    while len(parts) > 1:
        rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def by_words(text: Column, start: Callable[[], tuple[Callable[[str], list[str]], Callable[[str], list[int]], Callable[[list[int]], list[int]]]]) -> Column:
    """Ids of texts by words: ``start()`` runs once in each task and gives how to split a text, a word's ids, and how to frame a text's.

    A word's ids are kept for the whole task, so a frequent word is worked out once.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, ids_of, framed = start()
        kept = lru_cache(maxsize=50_000)(ids_of)
        for texts in batches:
            yield texts.map(lambda t: framed([i for w in split(t or "") for i in kept(w)]))

    return encode(text)


def spaced_words(text: str) -> list[str]:
    return [w for w in text.lower().strip().split(" ") if w]


def framed(ids: list[int]) -> list[int]:
    """Between the frame tokens, filled with zeros to ``LENGTH``."""
    ids = [START, *ids[: LENGTH - 2], END]
    return ids + [0] * (LENGTH - len(ids))


def plain_bpe(text: Column, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> Column:
    """Framed ids of the simpler tokenizer: merges know no word ends, each piece is looked up as a last one first, then as it is (STR-k)."""

    def start():
        ranks = ranked(merges)
        look = lambda p: vocabulary.get(p + "</w>", vocabulary.get(p))
        return spaced_words, lambda w: [i for p in first_merged(w, ranks) if (i := look(p)) is not None], framed

    return by_words(text, start)


def ranked_bpe(text: Column, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> Column:
    """Framed ids, filled with zeros to ``LENGTH``; symbols outside the vocabulary are left out."""

    def start():
        ranks = {p: k for k, p in enumerate(merges)}
        return spaced_words, lambda w: [vocabulary[p] for p in merged(w, ranks) if p in vocabulary], framed

    return by_words(text, start)


def words(text: str) -> list[str]:
    """Runs of letters and digits, and each other character that isn't white space."""
    return re.findall(r"[^\W_]+|[^\w\s]|_", text.lower())


def pieces(word: str, vocabulary: dict[str, int]) -> list[int]:
    """The longest piece that fits, again and again; a word with a stretch that nothing fits is unknown as a whole."""
    if len(word) > LONGEST:
        return [UNKNOWN]
    ids, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            found = vocabulary.get(("##" if at else "") + word[at:end])
            if found is not None:
                ids.append(found)
                at = end
                break
        else:
            return [UNKNOWN]
    return ids


def wordpiece(text: Column, vocabulary: dict[str, int]) -> Column:
    """Framed ids of the longest pieces, filled with zeros to ``PIECES`` (STR-l)."""

    def framed(ids: list[int]) -> list[int]:
        ids = [CLS, *ids[: PIECES - 2], SEP]
        return ids + [0] * (PIECES - len(ids))

    return by_words(text, lambda: (words, lambda w: pieces(w, vocabulary), framed))


def load_bpe(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges of a JSON file (SRC8)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


def load_wordpiece(path: str) -> dict[str, int]:
    """A vocabulary of a token in each line (SRC8)."""
    with open(path, encoding="utf-8") as f:
        return {line.rstrip("\n"): k for k, line in enumerate(f)}


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """The same as a table of ``token`` and ``id``, for a file in any store that Spark reads (SRC8)."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("id", "token"))
    return lines.select("token", F.col("id").cast("long").alias("id"))


def toy_bpe() -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Letters, and merges of common pairs: enough to show the rules where no vocabulary is at hand."""
    merges = [("t", "h"), ("e", "r"), ("a", "n"), ("th", "e</w>"), ("o", "n</w>"), ("i", "n"), ("in", "g</w>")]
    symbols = [c + end for c in "abcdefghijklmnopqrstuvwxyz0123456789.,?!'" for end in ("", "</w>")]
    return {s: k for k, s in enumerate([*symbols, *(a + b for a, b in merges)])}, merges


def toy_wordpiece() -> dict[str, int]:
    stems = [*"abcdefghijklmnopqrstuvwxyz0123456789.,?!'", "the", "an", "er", "ing", "re", "tion"]
    return {s: 200 + k for k, s in enumerate([*stems, *("##" + s for s in stems if s.isalnum())])}
