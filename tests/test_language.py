"""Zones with days of 23 hours and days without a midnight, and the tokenizers."""

import pytest
from pyspark.sql import functions as F

from recollect.functions import querytext as T
from recollect.functions import tokenizers
from recollect.plans.language import clip_vocabulary, wordpiece_vocabulary, zone


def one(spark, zone_name, text, now, f):
    with zone(spark, zone_name):
        return spark.createDataFrame([(text, now)], "q string, now long").select(f(F.col("q"), F.col("now")).alias("x")).first().x


def test_yesterday_of_23_hours(spark):
    now = 1773082800000  # 2026-03-09 15:00 in New York, the day after the clocks went forward
    w = one(spark, "America/New_York", "keys yesterday", now, T.relative_window)
    assert w.until_ms - w.since_ms == 23 * 3_600_000 - 1


def test_day_without_a_midnight(spark):
    now = 1541862000000  # 2018-11-10 15:00Z
    p = one(spark, "America/Sao_Paulo", "november 4", now, T.parse)
    assert p.since_ms == 1541300400000 and p.time_only  # 2018-11-04T03:00Z, the first instant of that day


def test_label_match(spark):
    pairs = [("cell phone", "phone", True), ("laptops", "laptop", True), ("cups", "cup", False), ("cat", "laptop", False)]
    df = spark.createDataFrame(pairs, "label string, q string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", T.label_matches(F.col("label"), T.tokens(F.col("q")))).collect())


def test_merges_of_least_rank_first():
    ranks = {("a", "b"): 1, ("b", "c</w>"): 0, ("a", "bc</w>"): 2}
    assert tokenizers.merged("abc", ranks) == ["abc</w>"]
    assert tokenizers.merged("abab", {("a", "b"): 0}) == ["ab", "a", "b</w>"]
    assert tokenizers.merged("aaa", {("a", "a"): 0}) == ["aa", "a</w>"]
    assert tokenizers.merged("aaaaa", {("a", "a"): 0}) == ["aa", "aa", "a</w>"]
    assert tokenizers.merged("x", {}) == ["x</w>"]


def test_ranked_bpe_is_framed(spark):
    vocabulary, merges = tokenizers.toy_bpe()
    df = spark.createDataFrame([("The the",), (None,), ("a " * 200,)], "t string")
    ids = [r.ids for r in df.select(tokenizers.ranked_bpe(F.col("t"), vocabulary, merges).alias("ids")).collect()]
    assert all(len(i) == 77 and i[0] == 49406 for i in ids)
    assert ids[0][1] == ids[0][2] == vocabulary["the</w>"] and ids[0][3] == 49407
    assert ids[1][1] == 49407 and ids[2][76] == 49407


def test_wordpiece(spark):
    v = tokenizers.toy_wordpiece()
    assert tokenizers.pieces("ther", v) == [v["the"], v["##r"]]
    assert tokenizers.pieces("éa", v) == [100] and tokenizers.pieces("a" * 101, v) == [100]
    assert tokenizers.words("Don't, stop_now") == ["don", "'", "t", ",", "stop", "_", "now"]
    ids = spark.createDataFrame([("the. " * 100,)], "t string").select(tokenizers.wordpiece(F.col("t"), v).alias("i")).first().i
    assert len(ids) == 64 and ids[0] == 101 and ids[-1] == 102


def test_ranked_bpe_is_the_library_s_on_plain_words(spark, small):
    library = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    whole = library.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    c = spark.read.parquet(f"{small}/conversations.parquet")
    words = [w for r in c.collect() for w in (r.text or "").lower().split() if w.isascii() and w.isalpha()][:400]
    texts = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    vocabulary, merges = clip_vocabulary()
    out = {r.i: r.ids for r in df.select("i", tokenizers.ranked_bpe(F.col("t"), vocabulary, merges).alias("ids")).collect()}
    assert len(texts) > 20
    for k, t in enumerate(texts):
        want = whole.encode(t, add_special_tokens=False).ids[: tokenizers.LENGTH - 2]
        ids = [tokenizers.START, *want, tokenizers.END]
        assert out[k] == ids + [0] * (tokenizers.LENGTH - len(ids))


def test_plain_bpe_is_a_plain_loop(spark, small):
    vocabulary, merges = clip_vocabulary()

    def loop(word):
        parts = [*word]
        while True:
            fits = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in known]
            if not fits:
                return [vocabulary.get(p + "</w>", vocabulary.get(p)) for p in parts]
            at = min(fits)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    known = set(merges)
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("text").limit(12)
    out = rows.select("text", tokenizers.plain_bpe(F.col("text"), vocabulary, merges).alias("ids")).collect()
    for r in out:
        want = [i for w in (r.text or "").lower().strip().split(" ") if w for i in loop(w) if i is not None][:75]
        assert r.ids == [49406, *want, 49407, *[0] * (75 - len(want))]


def test_wordpiece_on_a_public_vocabulary(spark, small):
    v = wordpiece_vocabulary()
    assert len(v) > 30_000 and min(v.values()) > tokenizers.SEP and len(set(v.values())) == len(v)

    def loop(word):
        ids, rest = [], word
        while rest:
            fits = [n for n in range(1, len(rest) + 1) if ("" if rest == word else "##") + rest[:n] in v]
            if not fits:
                return [tokenizers.UNKNOWN]
            ids.append(v[("" if rest == word else "##") + rest[: max(fits)]])
            rest = rest[max(fits) :]
        return ids

    rows = spark.read.parquet(f"{small}/conversations.parquet").select("text").limit(60)
    out = rows.select("text", tokenizers.wordpiece(F.col("text"), v).alias("ids")).collect()
    seen = [i for r in out for i in r.ids if i > tokenizers.SEP or i == tokenizers.UNKNOWN]
    assert seen.count(tokenizers.UNKNOWN) < 0.05 * len(seen)
    for r in out:
        want = [i for w in tokenizers.words(r.text or "") for i in loop(w)][:62]
        assert r.ids == [101, *want, 102, *[0] * (62 - len(want))]


def test_first_merge_of_the_list_wins():
    merges = [("b", "c"), ("a", "b"), ("bc", "d</w>")]
    merges = tokenizers.ranked(merges)
    assert tokenizers.first_merged("abcd", merges) == ["a", "bc", "d"]  # merges with a word end never fire
    assert tokenizers.first_merged("abab", merges) == ["ab", "ab"] and tokenizers.first_merged("", merges) == []
