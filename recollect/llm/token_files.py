"""Operator 3: token ids as flat binary files with 64-bit document offsets, and reading them back.

A store is a folder.  Each partition of the ordered input writes three flat little-endian files: ``.tok`` with the ids
as unsigned integers (16 bits if the vocabulary fits, else 32), ``.off`` with one more int64 than it has documents (where
each document begins in that partition, and the end), and ``.doc`` with the int64 document ids.  ``manifest.json`` lists
the partitions in order with their *bases*, the prefix sums of the partitions' token counts: the place of a document in
the whole store is its partition's base plus its offset.  Only the manifest (one line for each partition) passes through
the driver.  Files are memory-mapped where the store is a local path and read in ranges elsewhere.

A task writes files under a name of its own and reports them when it ends; the manifest lists what was reported, so
tasks that ran twice or were lost leave files that nothing points to.

Defined results: a null text counts as an empty one and has just the end id; documents stand in ascending id order, null
ids first (stored as the least int64 and read back as null), ties by a hash of their texts and then the texts; repeated rows are stored
each time; other columns aren't stored; an empty table gives a store without partitions, which reads as no rows.
"""

from __future__ import annotations

import json
import sys
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import NOT_LATIN, OTHER, Memo, byte_alphabet, latin
from .shared import bounded_batches

NO_ID = -(2**63)
MEMO_PIECES, MEMO_CHARS = 140_000, 48
#: Tokens in one Arrow batch when a store is read.
READ_TOKENS = 2_000_000


class LibraryEncoder:
    """The ``tokenizers`` library, asked once for each distinct piece.

    The library normalises a whole text; its pieces, cut by the tokenizer's own ``Split`` pattern, don't depend on each
    other, so the ids of a text are the ids of its pieces in order.  Texts with special tokens, with letters that Unicode
    versions class differently, or for a tokenizer of another kind, go through the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"] or {}]
        first, rest = steps[0], steps[1:]
        simple = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
        simple = simple and [(s["type"], s["use_regex"], s["add_prefix_space"]) for s in rest] == [("ByteLevel", False, False)]
        self.splitter, self.latin = (regex.compile(first["pattern"]["Regex"]), latin(first["pattern"]["Regex"])) if simple else (None, None)
        special = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None
        steps = spec["normalizer"] or {"type": "none"}
        self.lowers = [s["type"] for s in steps.get("normalizers", [steps])] == ["NFC", "Replace", "Lowercase"]
        self.dtype = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.model, self.code = self.library.model, "H" if self.dtype == "<u2" else "I"
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.pieces = Memo(self._piece_ids, MEMO_PIECES, MEMO_CHARS)

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece_ids(self, piece: str) -> bytes:
        """Of a piece in normal form: the library's model alone, on the characters that stand for the piece's bytes."""
        shown = piece.encode("utf-8").decode("latin-1").translate(self.shown)
        ids = array(self.code, [t.id for t in self.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def normal(self, text: str) -> str:
        """The library's normal form, but for white space, which no piece contains."""
        if self.library.normalizer is None:
            return text
        # str.lower() differs from the library's in the final sigma alone
        if self.lowers and "\u03a3" not in text and is_normalized("NFC", text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def encode(self, text: str) -> bytes:
        """The ids as unsigned integers of ``dtype``."""
        simple = self.splitter is not None and not OTHER.search(text)
        if not simple or (self.specials and self.specials.search(text)):
            return self._ids(text)
        normal = self.normal(text)
        pieces = (self.splitter if NOT_LATIN.search(normal) else self.latin).findall(normal)
        return b"".join(map(self.pieces.__getitem__, pieces))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def folder_of(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


PART = StructType().add("part", "integer").add("file", "string").add("docs", "long").add("tokens", "long")


def write_store(df: DataFrame, uri: str, tokenizer: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``text`` with the ``tokenizers`` library, append ``end_id`` to each document, and write a store at ``uri``."""
    spark = df.sparkSession
    bounded_batches(spark)
    dtype = encoder_of(tokenizer).dtype
    if end_id is not None and end_id >= 1 << 8 * np.dtype(dtype).itemsize:
        raise ValueError("end_id isn't in the range of the stored integers")
    end, width = b"" if end_id is None else np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
    place, root = folder_of(uri)
    place.create_dir(root, recursive=True)
    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    order = [F.col("d").asc_nulls_first(), F.xxhash64("t")]  # the hash splits a doc_id that very many rows share
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files, at, docs = TaskContext.get().partitionId(), None, 0, 0
        encoder = encoder_of(tokenizer)
        place, root = folder_of(uri)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [place.open_output_stream(f"{root}/{name}.{kind}") for kind in ("tok", "off", "doc")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            ends = []
            for t in batch.column(1).to_pylist():
                ids = encoder.encode(t) + end
                files[0].write(ids)
                at += len(ids) // width
                ends.append(at)
            files[1].write(np.array(ends, "<i8").tobytes())
            files[2].write(np.array([NO_ID if d is None else d for d in batch.column(0).to_pylist()], "<i8").tobytes())
            docs += batch.num_rows
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "docs": [docs], "tokens": [at]})

    # one short row for each partition
    parts = sorted((r.part, r.file, r.docs, r.tokens) for r in rows.mapInArrow(write, PART).collect())
    bases = [0, *accumulate(p[3] for p in parts)]
    manifest = {
        "dtype": dtype,
        "end_id": end_id,
        "tokens": bases[-1],
        "parts": [{"file": p[1], "docs": p[2], "tokens": p[3], "base": b} for p, b in zip(parts, bases, strict=False)],
    }
    with place.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())


class TokenStore:
    """A store on one machine: documents by their place, ids by their position in the whole store."""

    def __init__(self, uri: str):
        self.place, self.root = folder_of(uri)
        with self.place.open_input_stream(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.parts = self.manifest["parts"]
        self.first_doc = np.array([0, *accumulate(p["docs"] for p in self.parts)], np.int64)

    def array(self, part: int, kind: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values of a partition's file: a memory map of a local file, else a read of just that range."""
        dtype = np.dtype(self.manifest["dtype"] if kind == "tok" else "<i8")
        path = f"{self.root}/{self.parts[part]['file']}.{kind}"
        size = self.parts[part]["tokens"] if kind == "tok" else self.parts[part]["docs"] + (kind == "off")
        last = size if last is None else last
        if isinstance(self.place, pafs.LocalFileSystem):
            return np.memmap(path, dtype, "r", shape=(size,))[first:last] if size else np.zeros(0, dtype)
        with self.place.open_input_file(path) as f:
            return np.frombuffer(f.read_at((last - first) * dtype.itemsize, first * dtype.itemsize), dtype)

    def __len__(self) -> int:
        return int(self.first_doc[-1])

    def document(self, k: int) -> np.ndarray:
        """Ids of the document at place ``k``."""
        part = int(np.searchsorted(self.first_doc, k, "right")) - 1
        a, b = self.array(part, "off", k - int(self.first_doc[part]), k - int(self.first_doc[part]) + 2)
        return np.array(self.array(part, "tok", int(a), int(b)))


DOCUMENT = StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids", "binary")


def read_store(spark: SparkSession, uri: str) -> DataFrame:
    """One row for each document of a store: ``doc_id``, ``start``, ``n_tokens``, and its ids as little-endian 32-bit integers."""
    store = TokenStore(uri)
    n = len(store.parts)
    if not n:
        return spark.createDataFrame([], DOCUMENT)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = TokenStore(uri)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                base, docs = store.parts[part]["base"], store.parts[part]["docs"]
                offsets, names, first = store.array(part, "off"), store.array(part, "doc"), 0
                while first < docs:
                    last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_TOKENS, "right")) - 1)
                    last = min(last, docs, first + 20_000)
                    begin = np.array(offsets[first : last + 1])
                    ids = store.array(part, "tok", int(begin[0]), int(begin[-1])).astype("<u4").tobytes()
                    cuts = ((begin - begin[0]) * 4).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if d == NO_ID else d for d in names[first:last].tolist()], pa.int64()),
                            "start": pa.array(begin[:-1] + base),
                            "n_tokens": pa.array(np.diff(begin)),
                            "ids": pa.array([ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        }
                    )
                    first = last

    return spark.range(0, n, 1, n).mapInArrow(read, DOCUMENT)
