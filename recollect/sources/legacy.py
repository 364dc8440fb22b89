"""Points of the older memory: pictures are instants, transcripts are intervals with a vector in each space (SNK5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_points(df: DataFrame) -> DataFrame:
    """``id``, ``clip`` and ``payload`` of pictures (``id``, ``image_path``, ``clip``, ``timestamp_ms``)."""
    payload = F.to_json(F.struct(F.lit("image").alias("type"), "image_path", "timestamp_ms"))
    return df.select("id", "clip", F.lit(None).cast("array<float>").alias("text_vec"), payload.alias("payload"))


def transcript_points(df: DataFrame) -> DataFrame:
    """The same of transcripts (``id``, ``transcript``, ``clip``, ``text_vec``, ``t_start_ms``, ``t_end_ms``, ``image_path``); their time is their start."""
    fields = [F.lit("text").alias("type"), "transcript", "t_start_ms", "t_end_ms", "image_path", F.col("t_start_ms").alias("timestamp_ms")]
    return df.select("id", "clip", "text_vec", F.to_json(F.struct(*fields)).alias("payload"))


#: The longest base64 of a thumbnail that a payload carries (a fixed value).
THUMB_CHARS = 6144


def thumb_b64(jpeg: Column) -> Column:
    """A thumbnail's bytes as text; '' if there are none or they are too long for a payload (SNK13).  Scaling and compressing are the camera's."""
    text = F.translate(F.base64(jpeg), "\r\n", "")  # without line breaks
    return F.when(F.length(text) <= THUMB_CHARS, text).otherwise("")


def little(value: Column, size: int) -> Column:
    """The ``size`` least bytes of an integer, least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def wav_file(pcm: Column, rate: int = 16000) -> Column:
    """A WAV file of 16-bit mono samples: a head of 44 bytes before them (SNK12)."""
    n, raw = F.octet_length(pcm), lambda text: F.encode(F.lit(text), "UTF-8")
    form = [little(F.lit(v), size) for v, size in ((16, 4), (1, 2), (1, 2), (rate, 4), (2 * rate, 4), (2, 2), (16, 2))]
    return F.concat(raw("RIFF"), little(n + 36, 4), raw("WAVE"), raw("fmt "), *form, raw("data"), little(n, 4), pcm)


def ocr_points(frames: DataFrame, lines: DataFrame) -> DataFrame:
    """Points of the lines read from stored frames, beside the frames' own path (STR7).

    ``frames`` (``moment_id``, ``episode_id``, ``timestamp_ms``, ``width``, ``height``) are joined with ``lines`` (``moment_id``, ``line``, ``text``,
    ``box`` in pixels).  Blank lines are left out; a point takes moment, episode and time of its frame, whatever came since.
    """
    b = F.col("box")
    shares = [F.format_string("%.3f", b[side] / F.col(size)) for side, size in (("l", "width"), ("t", "height"), ("r", "width"), ("b", "height"))]
    kept = lines.filter(F.trim("text") != "").join(frames, "moment_id")
    return kept.select(
        "moment_id", "line", "episode_id", "timestamp_ms", F.col("timestamp_ms").alias("t_end_ms"), F.lit("ocr").alias("type"), F.lit("").alias("thumb_path"),
        F.concat_ws(",", *shares).alias("bbox"), F.lit("").alias("label"), "text",
    )
