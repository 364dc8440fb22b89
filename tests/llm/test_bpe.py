"""Operators 1 and 3 against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recollect.llm import bpe, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(BYTE), bpe.PrefixBpe(BYTE)
WORDS, ENCODER = Tokenizer.from_file(WORD), token_files.LibraryEncoder(WORD)


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)
    words = np.frombuffer(ENCODER.encode(text), ENCODER.dtype).tolist()
    assert words == WORDS.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    same(text)


@given(st.text(alphabet="aabehinrstu '.\n1é<|>", max_size=300))
@settings(max_examples=300, deadline=None)
def test_common_letters(text):
    same(text)


@pytest.mark.parametrize("text", ["", "a" * 20_000, " " * 500, "<|endoftext|>", "x<|endoftext|> <|startoftext|>y", "don't I'll WE'RE 's", "İ ΑΣ ſ K é", "՘ \U0001df90 ٣", "=" * 999, "\x00\x7f\xad�"])
def test_special_texts(text):
    same(text)


def test_every_token_alone():
    for i in random.Random(0).sample(range(50257), 3000):
        text = OWN.bytes_of[i].decode("utf-8", "replace")
        assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded():
    memo = bpe.Memo(len, 10, 5)
    assert [memo["a" * k] for k in range(100)] == list(range(100))
    assert len(memo) <= 10 and len(memo.older) <= 10 and max(map(len, memo)) <= 5


def test_column(spark, odd, nothing, clashing):
    for df in (odd, clashing):
        out = bpe.encode_decode(df, BYTE)
        rows = out.collect()
        assert len(rows) == odd.count()
        for r in rows:
            assert r.ids == LIBRARY.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.decoded == (r.text or "")
    assert bpe.encode_decode(clashing, BYTE).columns.count("ids") == 1
    assert bpe.encode_decode(nothing, BYTE).count() == 0


def test_store(spark, odd, odd_rows, nothing, tmp_path):
    uri = f"file://{tmp_path}/store"
    token_files.write_store(odd, uri, WORD, 2)
    rows = token_files.read_store(spark, uri).orderBy("start").collect()
    want = sorted(((-1 if d is None else d, t or "") for d, t, *_ in odd_rows))
    assert [(-1 if r.doc_id is None else r.doc_id) for r in rows] == [d for d, _ in want]
    assert sorted(r.n_tokens for r in rows) == sorted(len(WORDS.encode(t, add_special_tokens=False).ids) + 1 for _, t in want)
    at = 0
    store = token_files.TokenStore(uri)
    assert len(store) == len(rows)
    for k, r in enumerate(rows):
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 2
        assert store.document(k).tolist() == ids.tolist()
        at += len(ids)
    texts = {}
    for d, t, *_ in odd_rows:
        texts.setdefault(d, set()).add(zlib.crc32(np.array([*WORDS.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()))
    assert all(zlib.crc32(r.ids) in texts[r.doc_id] for r in rows)
    token_files.write_store(nothing, f"{uri}2", WORD, 2)
    assert token_files.read_store(spark, f"{uri}2").count() == 0


def test_files_of_lost_tasks_are_ignored(spark, odd, tmp_path):
    uri = str(tmp_path / "store")
    token_files.write_store(odd, uri, WORD, None)
    before = token_files.read_store(spark, uri).count()
    (tmp_path / "store" / "part-000000-deadbeef.tok").write_bytes(b"\1\2")
    assert token_files.read_store(spark, uri).count() == before


def test_listed_classes():
    """Every character that the fast splitter may see, in its neighbourhoods."""
    seen = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC)]
    assert not bpe.NOT_LATIN.search("".join(seen)) and all(bpe.NOT_LATIN.search(chr(c)) for c in (0x250, 0x2028, 0x2029, 0x3000, 0x2070))
    for c in seen:
        for text in (f"a{c}b1 {c}  {c}!", f"{c}{c} {c}\n"):
            assert OWN.latin.findall(text) == OWN.splitter.findall(text)
            assert ENCODER.latin.findall(text) == ENCODER.splitter.findall(text)
            same(text)
