"""Boxes, luma grids, text lines and sound as column arithmetic (GEO, IMG, OCR, SIG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores and overlaps (fixed values): least detection score, overlap above which a box is suppressed, overlap of a track.
SCORE, SUPPRESS, SAME_TRACK = 0.25, 0.45, 0.4


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (l, t, r, b) over their union; 0 if they don't meet (GEO1)."""
    w = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    h = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    area = lambda x: (x["r"] - x["l"]) * (x["b"] - x["t"])
    shared = w * h
    union = area(a) + area(b) - shared
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(shared / union)


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))


def decoded(cx: Column, cy: Column, w: Column, h: Column, grid: float, width: float, height: float) -> Column:
    """A detector's box (middle and size on its grid) on the picture, cut at its edges; null if nothing is left (GEO2)."""
    cut = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), F.lit(most))
    sx, sy = width / grid, height / grid
    out = box(cut((cx - w / 2) * sx, width), cut((cy - h / 2) * sy, height), cut((cx + w / 2) * sx, width), cut((cy + h / 2) * sy, height))
    return F.when((out["r"] > out["l"]) & (out["b"] > out["t"]), out)


def suppressed(detections: DataFrame, most: float = SUPPRESS) -> DataFrame:
    """Of boxes of a label in a frame that overlap more than ``most``, the best stay (GEO3).  (``frame``, ``label``, ``det``, ``score``, ``box``.)

    Suppression depends on what was kept before, so a frame's boxes of a label, at most a few hundred, are folded in one array.
    """
    item = F.struct((-F.col("score")).alias("o"), "det", "score", "box")
    groups = detections.groupBy("frame", "label").agg(F.array_sort(F.collect_list(item)).alias("d"))
    kept = F.aggregate("d", F.slice("d", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: iou(k["box"], x["box"]) > most), acc).otherwise(F.concat(acc, F.array(x))))
    return groups.select("frame", "label", F.explode(kept).alias("k")).select("frame", "label", "k.det", "k.score", "k.box")


def padded(b: Column, width: int, height: int, share: float = 0.2) -> Column:
    """A box grown on each side, whole pixels, cut at the picture's edges, a pixel at least (GEO4)."""
    dx, dy = (b["r"] - b["l"]) * share, (b["b"] - b["t"]) * share
    cut = lambda x, low, high: F.least(F.greatest(x.cast("int"), low), high)
    left = cut(b["l"] - dx, F.lit(0), F.lit(width - 1))
    top = cut(b["t"] - dy, F.lit(0), F.lit(height - 1))
    return box(left, top, cut(b["r"] + dx, left + 1, F.lit(width)), cut(b["b"] + dy, top + 1, F.lit(height)))


def normalised(b: Column, width: float, height: float) -> Column:
    """From pixels to shares of the picture (GEO5)."""
    cut = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return box(cut(b["l"] / width), cut(b["t"] / height), cut(b["r"] / width), cut(b["b"] / height))


# --- pictures


def between(a: Column, b: Column, share: float = 0.3) -> Column:
    """The box that has gone ``share`` of the way from ``a`` to ``b``, as boxes are drawn (GEO6)."""
    return box(*[a[c] + (b[c] - a[c]) * share for c in "ltrb"])


def luminance(argb: Column) -> Column:
    """0 to 255 of a packed colour (IMG1)."""
    part = lambda shift: F.shiftright(argb, shift).bitwiseAND(F.lit(255))
    return (part(16) * 0.299 + part(8) * 0.587 + part(0) * 0.114).cast("int")


def downscaled(luma: Column, width: int, height: int, side: int = 32) -> Column:
    """Means of blocks of a picture, row by row, as shares of 255 (IMG2)."""
    if width <= 0 or height <= 0:
        return F.transform(F.sequence(F.lit(1), F.lit(side * side)), lambda _: F.lit(0.0))

    def edge(k: Column, size: int) -> tuple[Column, Column]:
        first = F.floor(k * size / side).cast("int")
        return first, F.greatest(F.floor((k + 1) * size / side).cast("int"), first + 1)

    def cell(k: Column) -> Column:
        y0, y1 = edge(F.floor(k / side).cast("int"), height)
        x0, x1 = edge(F.pmod(k, F.lit(side)), width)
        rows = F.flatten(F.transform(F.sequence(y0, y1 - 1), lambda y: F.slice(luma, y * width + x0 + 1, x1 - x0)))
        return F.aggregate(rows, F.lit(0.0), lambda s, v: s + v) / F.size(rows) / 255.0

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), cell)


def similarity(a: Column, b: Column) -> Column:
    """1 minus the mean absolute difference (IMG3, IMG5)."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def sharpness(grid: Column, side: int) -> Column:
    """Variance of the differences between cells and their four neighbours, edges repeated (IMG4)."""
    at = lambda y, x: F.get(grid, F.least(F.greatest(y, F.lit(0)), F.lit(side - 1)) * side + F.least(F.greatest(x, F.lit(0)), F.lit(side - 1)))

    def edge(k: Column) -> Column:
        y, x = F.floor(k / side).cast("int"), F.pmod(k, F.lit(side))
        return at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x)

    edges = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), edge)
    mean = lambda e: F.aggregate(e, F.lit(0.0), lambda s, v: s + v) / F.size(e)
    return mean(F.transform(edges, lambda v: v * v)) - mean(edges) * mean(edges)


#: Means and deviations by which channels are normalised (IMG6; fixed values of the encoders).
CHANNELS = {
    "clip": ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)),
    "imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
    "half": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)),
}


def channel(value: Column, encoder: str, k: int) -> Column:
    return (value / 255.0 - CHANNELS[encoder][0][k]) / CHANNELS[encoder][1][k]


def dequantised(u8: Column, zero: int, scale: float) -> Column:
    """IMG7."""
    return (u8 - zero) * scale


# --- text in pictures


def line_boxes(cells: DataFrame, width: int, height: int, threshold: float = 0.3, least_rows: int = 6, pad: int = 4) -> DataFrame:
    """Lines of text of a map of probabilities (``image``, ``y``, ``x``, ``p``): runs of rows with enough marked cells (OCR1)."""
    need = max(3, int(width * 0.005))
    marked = cells.filter(F.col("p") > threshold).groupBy("image", "y").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1")).filter(F.col("n") >= need)
    run = F.col("y") - F.row_number().over(Window.partitionBy("image").orderBy("y"))
    runs = marked.withColumn("run", run).groupBy("image", "run").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    runs = runs.filter(F.col("y1") - F.col("y0") + 1 >= least_rows)
    return runs.select(
        "image",
        F.greatest(F.col("x0") - pad, F.lit(0)).alias("l"),
        F.greatest(F.col("y0") - pad, F.lit(0)).alias("t"),
        F.least(F.col("x1") + pad, F.lit(width)).alias("r"),
        F.least(F.col("y1") + 1 + pad, F.lit(height)).alias("b"),
    )


def ctc(steps: DataFrame, alphabet: list[str]) -> DataFrame:
    """Text of (``line``, ``t``, ``scores``): the best class of each step, without class 0 and repeats (OCR2); ``conf`` is the mean best score."""
    best = F.array_max("scores")
    won = steps.select("line", "t", best.alias("best"), (F.array_position("scores", best) - 1).cast("int").alias("k"))
    w = Window.partitionBy("line").orderBy("t")
    new = won.withColumn("last", F.lag("k").over(w)).filter((F.col("k") > 0) & ((F.col("last").isNull()) | (F.col("last") != F.col("k"))))
    letter = F.get(F.array(*map(F.lit, alphabet)), F.col("k") - 1)
    read = new.groupBy("line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", letter.alias("c")))), lambda x: x["c"]), "").alias("text"),
        F.round(F.avg("best"), 6).alias("conf"),
    )
    return steps.select("line").distinct().join(read, "line", "left").select("line", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("conf", F.lit(0.0)).alias("conf"))


def until_stop(steps: DataFrame, alphabet: list[str]) -> DataFrame:
    """Text of steps after the first and before the first stop class 1; classes from 2 on are letters (OCR3)."""
    best = F.array_max("scores")
    won = steps.filter("t > 0").select("line", "t", best.alias("best"), (F.array_position("scores", best) - 1).cast("int").alias("k"))
    stop = won.filter("k = 1").groupBy("line").agg(F.min("t").alias("stop"))
    kept = won.join(stop, "line", "left").filter((F.col("stop").isNull() | (F.col("t") < F.col("stop"))) & (F.col("k") >= 2))
    letter = F.get(F.array(*map(F.lit, alphabet)), F.col("k") - 2)
    return kept.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", letter.alias("c")))), lambda x: x["c"]), "").alias("text"), F.round(F.avg("best"), 6).alias("conf"))


# --- sound


def rms(samples: Column) -> Column:
    """AGG8."""
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.greatest(F.size(samples), F.lit(1)))


def speech_runs(chunks: DataFrame, loud: float = 50.0, silence_ms: int = 1000) -> DataFrame:
    """Utterances of (``key``, ``ts``, ``rms``): loud chunks with no more than ``silence_ms`` between them (SIG1)."""
    w = Window.partitionBy("key").orderBy("ts")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= silence_ms, 0).otherwise(1)
    runs = chunks.filter(F.col("rms") > loud).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("key", "run").agg(F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"), F.count("*").alias("chunks"))


def trimmed(first: Column, last: Column, size: Column, rate: int = 16000, pad_ms: int = 300, least_ms: int = 250) -> Column:
    """Bytes of 16-bit speech with a margin, whole samples; null if it is too short (SIG2)."""
    pad = pad_ms * rate // 1000 * 2
    start, end = F.greatest(first - pad, F.lit(0)), F.least(last + pad, size)
    start, end = start - F.pmod(start, F.lit(2)), end - F.pmod(end, F.lit(2))
    return F.when(end - start >= least_ms * rate // 1000 * 2, F.struct(start.cast("long").alias("first"), end.cast("long").alias("last")))
