"""Operator 7: the codecs sample by sample, round trips, odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import queries, telephony as T


def test_laws():
    """Expanded codes, compressed by the definition of each law, give the codes back."""

    def mu(x):
        sign, x = (0x80, -x) if x < 0 else (0, x)
        x = min(x, 32635) + 132
        e = x.bit_length() - 8
        return ~(sign | e << 4 | (x >> (e + 3) & 15)) & 0xFF

    assert all(mu(int(T.MU[c])) == c for c in range(256) if c != 127)  # 127 is minus zero
    assert T.MU[0] == -32124 and T.MU[128] == 32124 and T.MU[255] == 0
    assert T.A[0xD5] == 8 and T.A[0x55] == -8 and T.A[0xAA] == 32256 and len(set(T.A.tolist())) == 256


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(T.STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(T.INDEX_MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks():
    data = np.random.default_rng(1).integers(0, 256, (40, 64), dtype=np.uint8)
    assert T.adpcm_samples(data).tolist() == [s for b in data for s in plain_adpcm(bytes(b))]


def plain_feature(name, samples):
    """A codec's own part of a feature, and what resampling to twice the rate gives, by loops."""
    rms = (sum(int(x) ** 2 for x in samples) / len(samples)) ** 0.5
    turns = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
    taps, half = T.sinc_filter(2, 1), 16
    wide = []
    for i in range(2 * len(samples)):  # a sample stands at each even place, zeros between
        near = range((max(i - half, 0) + 1) // 2, min((i + half) // 2, len(samples) - 1) + 1)
        wide.append(max(-32768, min(32767, round(sum(samples[k] * taps[half + i - 2 * k] for k in near)))))
    return f"{name};n={len(samples)};rms={rms:.3f};peak={max(abs(int(x)) for x in samples)};turns={turns};resampled={2 * len(samples)}", wide


def test_features_by_loops(spark, monkeypatch):
    texts = ["", "a", "mu-law and A-law " * 20, "é日\U0001f600" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = {r.doc_id: r.feature.split("|") for r in queries.op7_telephony(spark, "").collect()}
    sound = {r.doc_id: np.frombuffer(T.parse(bytes(r.pcm))[3], "<i2") for r in T.decode_media(media_of(docs)).collect()}
    for k, t in enumerate(texts):
        raw = t.encode()
        sent = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        mu, a = [int(T.MU[c]) for c in sent], [int(T.A[c]) for c in sent]
        blocks = [x for j in range(0, len(sent), 64) for x in plain_adpcm(sent[j : j + 64])]
        assert len(got[k]) == 3
        for told, (name, samples) in zip(got[k], (("mulaw", mu), ("alaw", a), ("adpcm", blocks)), strict=True):
            want, wide = plain_feature(name, samples)
            assert told.rsplit(";", 1)[0] == want
            if name == "mulaw":
                assert np.abs(sound[k].astype(int) - np.array(wide)).max() <= 1
                assert told.endswith(hashlib.sha256(sound[k].tobytes()).hexdigest()[:16])


def media_of(docs):
    return T.store_payloads(docs, queries.padded(F.encode("text", "UTF-8")), F.lit(T.MU_LAW))


def test_resampling_keeps_a_tone():
    taps = T.sinc_filter(2, 1)
    tone = (10_000 * np.sin(np.arange(800) * 2 * np.pi * 440 / 8000)).astype(np.int16)
    want = 10_000 * np.sin(np.arange(1600) * 2 * np.pi * 440 / 16000)
    assert np.abs(T.resample(tone, 2, 1, taps) - want)[50:-50].max() < 5
    assert len(T.resample(tone[:1], 2, 1, taps)) == 2 and len(T.resample(tone[:0], 2, 1, taps)) == 0
    assert len(T.resample(tone, 3, 2, T.sinc_filter(3, 2))) == 1200


@pytest.mark.parametrize("kind", [T.MU_LAW, T.A_LAW, T.ADPCM, T.PCM])
def test_wav(kind):
    data = bytes(range(256))
    assert T.parse(T.wav(kind, data))[3] == data and T.parse(T.wav(kind, data))[0] == kind
    assert T.parse(T.wav(kind, data)[:-9]) is None


def test_not_wav():
    assert T.parse(None) is None and T.parse(b"") is None and T.parse(b"RIFFxxxxWAVE") is None and T.parse(b"x" * 100) is None
    with pytest.raises(ValueError, match="whole blocks"):
        T.wav(T.ADPCM, b"123")


def test_query_digests(spark, odd, odd_rows, nothing, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: odd)
    rows = queries.op7_telephony(spark, "").collect()
    assert len(rows) == len(odd_rows)
    want = set()
    for d, t, *_ in odd_rows:
        raw = (t or "").encode()
        sent = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.add((d, len(raw), len(sent), hashlib.sha256(sent).hexdigest(), zlib.crc32(sent[-64:])))
    assert {tuple(r)[:5] for r in rows} == want
    by_text = {}
    for r in rows:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(v) == 1 for v in by_text.values())
    monkeypatch.setattr(queries, "table", lambda *_: nothing)
    assert queries.op7_telephony(spark, "").count() == 0


def test_decode_keeps_pcm(spark):
    df = spark.createDataFrame([(1, bytearray(T.wav(T.MU_LAW, b"abc" * 50))), (2, None), (3, bytearray(b"junk"))], "id long, media binary")
    rows = {r.id: r for r in T.decode_media(df.withColumn("rate", F.lit("own"))).collect()}
    kind, rate, _, pcm = T.parse(bytes(rows[1].pcm))
    assert (kind, rate, len(pcm)) == (T.PCM, 16000, 600) and rows[1].pcm_sha256 == hashlib.sha256(pcm).hexdigest()
    assert rows[2].codec is None and rows[3].payload is None
