"""Operator 7: telephony audio as media columns.

Audio is stored as WAV files in a binary column: mu-law (format 7), A-law (6), IMA ADPCM (0x11) or 16-bit PCM (1).
mu-law and A-law samples are expanded by tables of 256 values; ADPCM blocks are decoded with numpy, step by step within
the blocks and across all blocks of a batch of files at once; the PCM is resampled (band-limited, by a windowed sinc
filter of fixed length, in a rational ratio) and stored as 16-bit PCM.

The same bytes can be read by several codecs: ``readings`` adds what others than the file's own make of its data.

``store_payloads`` puts any bytes losslessly into the data chunk of such a file: bytes are mu-law or A-law samples as
they are, and a multiple of the block size is a sequence of ADPCM blocks.  ``decode_media`` reads files and gives their
payload, PCM and features.

Defined results: a null payload gives a null file; a null file, or bytes that aren't such a WAV file, gives null fields;
an empty data chunk gives no samples and features of zero.  Rows are independent, so equal bytes give equal values.
Columns of the input with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .shared import arrow_column, with_fields

PCM, A_LAW, MU_LAW, ADPCM = 1, 6, 7, 0x11
NAMES = {PCM: "pcm", A_LAW: "alaw", MU_LAW: "mulaw", ADPCM: "adpcm"}
RATE = 8000
#: Bytes of an ADPCM block, of which 4 are its head; each other byte has two samples.
BLOCK = 64
#: ADPCM blocks decoded at once, which bounds memory.
BLOCKS_AT_ONCE = 1 << 16

#: How an ADPCM code moves the step index (fixed values of the IMA format).
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def step_sizes() -> np.ndarray:
    """The 89 steps of IMA ADPCM: from 7 on each step is a tenth more than the last, rounded down as the format does."""
    #: fixed values of the IMA format
    return np.array(
        [
            7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
            107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
            876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
            4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
            22385, 24623, 27086, 29794, 32767,
        ],
        np.int32,
    )


def mu_law_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes: inverted bits, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes: even bits inverted, sign, exponent, mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


STEPS, MU, A = step_sizes(), mu_law_table(), a_law_table()


def adpcm_samples(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM blocks (an array of blocks by bytes), decoded across all blocks at once."""
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (blocks.shape[1] - 4) + 1, len(blocks)), np.int16)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(len(columns)):
        for half in (0, 1):
            code = (columns[k] >> 4 * half & 15).astype(np.int32)
            size, step = code & 7, STEPS[index]
            # the sum of step/8, and step, step/2 and step/4 where their bits are set, each rounded down
            change = (step >> 3) + (step >> 2) * (size & 1) + (step >> 1) * (size >> 1 & 1) + step * (size >> 2)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_MOVES[size], 0, 88)
            out[2 * k + half + 1] = value
    return np.ascontiguousarray(out.T).reshape(-1)


def wav(kind: int, data: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAV file with ``data`` as it is in its data chunk."""
    if kind == ADPCM:
        if len(data) % block:
            raise ValueError("ADPCM data must be whole blocks")
        samples = 2 * (block - 4) + 1
        form = struct.pack("<HHIIHHHH", kind, 1, rate, rate * block // samples, block, 4, 2, samples)
        fact = struct.pack("<I", len(data) // block * samples)
    else:
        width = 2 if kind == PCM else 1
        form = struct.pack("<HHIIHH", kind, 1, rate, rate * width, width, 8 * width) + (b"" if kind == PCM else b"\0\0")
        fact = struct.pack("<I", len(data) // width)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form
    body += b"" if kind == PCM else b"fact" + struct.pack("<I", 4) + fact
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """Kind, rate, block size and data of a mono WAV file; None if it isn't one."""
    if media is None or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        chunk = media[at + 8 : at + 8 + size]
        if name == b"fmt " and len(chunk) >= 16:
            form = struct.unpack_from("<HHIIHH", chunk)
        if name == b"data":
            known = form and len(chunk) == size and form[1] == 1 and form[0] in NAMES
            known = known and not (form[0] == ADPCM and (form[4] <= 4 or size % form[4]))
            return (form[0], form[2], form[4], chunk) if known else None
        at += 8 + size + size % 2
    return None


def sinc_filter(up: int, down: int, half: int = 8) -> np.ndarray:
    """A low-pass filter for a resampling ratio: a sinc under a Hann window, of unit gain after ``up`` zeros a sample."""
    widest = max(up, down)
    t = np.arange(-half * widest, half * widest + 1)
    taps = np.sinc(t / widest) * (0.5 + 0.5 * np.cos(np.pi * t / (half * widest + 1)))
    return taps * (up / taps.sum())


def resample(samples: np.ndarray, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """``samples`` at ``up/down`` times the rate, as 16-bit samples: one short convolution for each phase."""
    n = -(-len(samples) * up // down)
    if not n:
        return np.zeros(0, np.int16)
    half = len(taps) // 2
    wide = np.empty(len(samples) * up, np.float32)
    x = samples.astype(np.float32)
    for phase in range(up):  # the places phase, phase + up, ... see every up-th tap
        own = taps[(phase + half) % up :: up].astype(np.float32)
        shift = (phase + half) // up
        full = np.convolve(x, own)
        wide[phase::up] = full[shift : shift + len(x)] if len(full) >= shift + len(x) else np.pad(full[shift:], (0, shift + len(x) - len(full)))
    return np.clip(np.rint(wide[::down][:n]), -32768, 32767).astype(np.int16)


def store_payloads(df: DataFrame, payload: Column, kind: Column, name: str = "media") -> DataFrame:
    """``df`` with ``name``, WAV files that hold the bytes of ``payload``; ``kind`` is 6, 7 or 0x11 in each row."""

    def start():
        return lambda data, kinds: pa.array(
            [None if d is None or k is None else wav(k, d) for d, k in zip(data, kinds, strict=True)], pa.binary()
        )

    return df.withColumn(name, arrow_column(df, start, BinaryType(), payload, kind))


MEDIA = (
    StructType()
    .add("codec", "string").add("rate", "integer").add("payload", "binary").add("samples", "long")
    .add("pcm_rate", "integer").add("pcm_sha256", "string").add("feature", "string").add("pcm", "binary")
)


def features(kind: int, samples: np.ndarray, resampled: int, sha: str) -> str:
    """Codec, number of samples, loudness, peak, sign changes of the samples; number and digest of the resampled ones."""
    if len(samples):
        x = samples.astype(np.float64)
        rms, peak = float(np.sqrt(np.dot(x, x) / len(x))), int(np.abs(x).max())
        turns = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    else:
        rms, peak, turns = 0.0, 0, 0
    return f"{NAMES[kind]};n={len(samples)};rms={rms:.3f};peak={peak};turns={turns};resampled={resampled};pcm={sha[:16]}"


def decode_media(df: DataFrame, media: str = "media", rate: int = 16000, keep_pcm: bool = True, readings: tuple[int, ...] = ()) -> DataFrame:
    """``df`` with the fields of ``MEDIA`` read from the WAV files in ``media``; ``pcm`` is a WAV file at ``rate``.

    ``keep_pcm=False`` leaves ``pcm`` null after its features are taken.  ``feature`` also has the features of the data read by the codecs
    of ``readings``, whole blocks of ``BLOCK`` bytes for ADPCM, joined by ``|``.
    """

    def start():
        taps: dict[tuple[int, int], np.ndarray] = {}

        def expand(found: list) -> list[np.ndarray | None]:
            out: list[np.ndarray | None] = [None] * len(found)
            by_block: dict[int, list[int]] = {}
            for i, f in enumerate(found):
                if f is None:
                    continue
                kind, _, block, data = f
                if kind == ADPCM:
                    by_block.setdefault(block, []).append(i)
                elif kind == PCM:
                    out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
                else:
                    out[i] = (MU if kind == MU_LAW else A)[np.frombuffer(data, np.uint8)]
            for block, members in by_block.items():
                joined = np.frombuffer(b"".join(found[i][3] for i in members), np.uint8).reshape(-1, block)
                sound = [adpcm_samples(joined[a : a + BLOCKS_AT_ONCE]) for a in range(0, len(joined), BLOCKS_AT_ONCE)]
                sound, at = np.concatenate(sound) if sound else np.zeros(0, np.int16), 0
                for i in members:
                    n = len(found[i][3]) // block * (2 * (block - 4) + 1)
                    out[i], at = sound[at : at + n], at + n
            return out

        def resampled(samples: np.ndarray, own_rate: int) -> bytes:
            shared = np.gcd(rate, own_rate)
            ratio = (rate // int(shared), own_rate // int(shared))
            if ratio not in taps:
                taps[ratio] = sinc_filter(*ratio)
            return resample(samples, *ratio, taps[ratio]).astype("<i2").tobytes()

        def batch(files: list) -> pa.Array:
            found = [parse(f) for f in files]
            also = [[f and (kind, f[1], BLOCK, f[3][: len(f[3]) // BLOCK * BLOCK] if kind == ADPCM else f[3]) for f in found] for kind in readings]
            also = [expand(one) for one in also]
            rows = []
            for i, (f, samples) in enumerate(zip(found, expand(found), strict=True)):
                if f is None:
                    rows.append(None)
                    continue
                kind, own_rate, _, data = f
                raw = resampled(samples, own_rate)
                sha = hashlib.sha256(raw).hexdigest()
                told = [features(kind, samples, len(raw) // 2, sha)]
                for other, sound in zip(readings, also, strict=True):
                    heard = resampled(sound[i], own_rate)
                    told.append(features(other, sound[i], len(heard) // 2, hashlib.sha256(heard).hexdigest()))
                rows.append(
                    {
                        "codec": NAMES[kind], "rate": own_rate, "payload": data, "samples": len(samples), "pcm_rate": rate,
                        "pcm_sha256": sha, "feature": "|".join(told), "pcm": wav(PCM, raw, rate) if keep_pcm else None,
                    }
                )
            kinds = [("codec", pa.string()), ("rate", pa.int32()), ("payload", pa.binary()), ("samples", pa.int64()), ("pcm_rate", pa.int32()), ("pcm_sha256", pa.string()), ("feature", pa.string()), ("pcm", pa.binary())]
            return pa.array(rows, pa.struct(kinds))

        return batch

    return with_fields(df, arrow_column(df, start, MEDIA, F.col(media)), MEDIA)
