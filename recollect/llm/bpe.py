"""Operator 1: BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a piece there is exactly one token that the BPE encoding of that prefix ends with.  An automaton
over the vocabulary gives the tokens that are suffixes of the prefix; the one that fits after the last token of the
prefix before it is the last token of this prefix.  "Fits" means that no merge would cross the border between the two
tokens, which is decided from the merge ranks alone.  The stored tokens are back-pointers: following them from the end
gives the ids.  The time is linear in the text, also for a text without any white space.

Pieces (the words of the tokenizer's own splitting rule) are encoded once and kept in a memo of bounded size.

Defined results: a null text counts as an empty one; an empty text has no ids and decodes to an empty text; rows are
independent of each other, so ties and repeated rows give equal results; columns named ``n_tokens``, ``ids`` or
``decoded`` in the input are replaced by the operator's; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .shared import arrow_column, text_or_empty, with_fields

#: Where the splitting rule's classes are the same in all Unicode versions from 10 on; other texts are split by the
#: tokenizer's own library.
STABLE = r"\u0000-ԯḀ-῿‐-⁰₠-₿　-ヿ一-龥가-힣"
OTHER = regex.compile(f"[^{STABLE}]")

#: Where letters, numbers and white space can be listed: Latin letters, and punctuation.  Such texts are split by ``re``, in half the time.
LETTERS, NUMBERS, SPACES = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
NOT_LATIN = re.compile("[^\\0-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")

#: The splitting rule of byte-level BPE (a fixed value of the tokenizer).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces kept in memory, and the longest of them.
MEMO_PIECES, MEMO_CHARS = 130_000, 48
#: Pairs of tokens kept in memory.
MEMO_PAIRS = 100_000

OUTPUT = StructType(
    [
        StructField("n_tokens", LongType()),
        StructField("ids", ArrayType(IntegerType())),
        StructField("decoded", StringType()),
    ]
)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def latin(pattern: str) -> re.Pattern[str]:
    """A splitting rule for Latin texts: its classes of letters, numbers and white space written out."""
    listed, out, at, inside = {"\\p{L}": LETTERS, "\\p{N}": NUMBERS, "\\s": SPACES}, "", 0, False
    while at < len(pattern):
        name = next((k for k in (*listed, "\\S") if pattern.startswith(k, at)), None)
        if name == "\\S":
            out += f"[^{SPACES}]"
        elif name:
            out += listed[name] if inside else f"[{listed[name]}]"
        else:
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out += pattern[at]
        at += len(name or "x")
    return re.compile(out)


class Memo(dict):
    """Values by key, computed when first asked for.  At most twice ``size`` are held: the older half goes at once."""

    def __init__(self, compute, size: int, longest: int | None = None):
        super().__init__()
        self.compute, self.size, self.longest, self.older = compute, size, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixBpe:
    """A byte-level BPE tokenizer read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        as_bytes = lambda shown: bytes(alphabet[c] for c in shown)
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for shown, i in vocab.items():
            self.bytes_of[i] = as_bytes(shown)
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.size_of = list(map(len, self.bytes_of))
        #: For each token the rank of the merge that makes it, and that merge's two tokens; bytes have rank -1.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = rank
            self.rank[made], self.left[made], self.right[made] = rank, vocab[a], vocab[b]
        self.automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        for i in sorted(vocab.values(), key=self.rank.__getitem__):
            whole[i] = self.rank[i] < 0 or (
                whole[self.left[i]] and whole[self.right[i]] and not self._crossed(self.left[i], self.right[i], self.rank[i])
            )
            if whole[i]:  # a token that its own bytes don't encode to is never used
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits = Memo(lambda pair: not self._crossed(pair >> 32, pair & 0xFFFFFFFF), MEMO_PAIRS)
        self.pieces = Memo(self.encode_piece, MEMO_PIECES, MEMO_CHARS)
        self.splitter, self.latin = regex.compile(SPLIT), latin(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self.library = path, None

    def _crossed(self, a: int, b: int, own: int | None = None) -> bool:
        """Whether a merge crosses the border when the bytes of ``a`` and ``b`` are encoded together.

        The tokens beside the border grow from bytes to ``a`` and to ``b``.  Going back in time, the later of the two
        last merges is undone, until both are bytes; at each moment the two tokens beside the border merge if their
        merge comes before the next growth of either.  ``own``: rank of the merge of ``a`` and ``b`` themselves, which
        may then happen at the end.
        """
        until_a = until_b = len(self.rank) if own is None else own
        while True:
            rank = self.merge.get((a, b))
            # of two equal merges that overlap the left one happens, so a tie lets the border's merge win over b's
            if rank is not None and rank != own and rank < until_a and rank <= until_b:
                return True
            grew_a, grew_b = self.rank[a], self.rank[b]
            if grew_a < 0 and grew_b < 0:
                return False
            if grew_a > grew_b:
                until_a, a = grew_a, self.right[a]
            else:
                until_b, b = grew_b, self.left[b]

    def encode_piece(self, piece: str) -> bytes:
        """The ids of a piece as 32-bit integers of this machine.

        Matches come by their end, so each prefix's last token is known before a longer prefix asks for it.
        """
        data = piece.encode("utf-8").decode("latin-1")
        last = [-1] * (len(data) + 1)
        fits, size = self.fits, self.size_of
        for end, token in self.automaton.iter(data):
            end += 1
            if last[end] < 0:
                begin = end - size[token]
                if not begin or fits[last[begin] << 32 | token]:
                    last[end] = token
        ids, end = array("i"), len(data)
        while end:
            ids.append(last[end])
            end -= size[last[end]]
        ids.reverse()
        return ids.tobytes()

    def split(self, text: str) -> list[str]:
        if not NOT_LATIN.search(text):
            return self.latin.findall(text)
        if not OTHER.search(text):
            return self.splitter.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        ends: list[tuple[int, int]] = []
        for _, span in self.library.pre_tokenize_str(text):
            if not ends or span != ends[-1]:
                ends.append(span)
        return [text[a:b] for a, b in ends]

    def encode_bytes(self, text: str) -> bytes:
        """The ids that the ``tokenizers`` library gives, without added special tokens, as 32-bit integers of this machine."""
        if self.specials is None or not self.specials.search(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        out: list[bytes] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                out += map(self.pieces.__getitem__, self.split(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> PrefixBpe:
    """The tokenizer of a file, kept with its memo for the later tasks of the same worker."""
    return PrefixBpe(path)


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` and ``decoded`` (the text that the ids give back) of its column ``text``."""

    def start():
        bpe = tokenizer_of(tokenizer)
        kind = pa.struct([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

        def batch(texts: list[str]) -> pa.Array:
            coded = [bpe.encode_bytes(t) for t in texts]
            sizes = np.array([len(c) // 4 for c in coded], np.int64)
            values = np.frombuffer(b"".join(coded), np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            # decoded from the ids that are returned
            decoded = [bpe.decode(values[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            return pa.StructArray.from_arrays([pa.array(sizes), ids, pa.array(decoded, pa.string())], fields=list(kind))

        return batch

    return with_fields(df, arrow_column(df, start, OUTPUT, text_or_empty(text)), OUTPUT)
