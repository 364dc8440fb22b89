"""The moment collection: its schema, readers of payloads, and the collection derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.vectors import dot

#: The 80 COCO class names in their order (fixed values of that data set).
COCO_NAMES = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign",
    "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella",
    "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard",
    "surfboard", "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed", "dining table", "toilet", "tv",
    "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase",
    "scissors", "teddy bear", "hair drier", "toothbrush",
]

#: Thresholds by encoder: search gate, verification gate, scene duplicate (FUS17; fixed values).
GATES = [("relay", 0.08, 0.06, 0.90), ("tiny", 0.25, 0.20, 0.85), ("b32", 0.25, 0.20, 0.85), ("device", 0.085, 0.06, 0.90)]
SEARCH_GATE, VERIFY_GATE, SCENE_GATE = 0.085, 0.06, 0.90

#: Payload fields by their names on the wire; a missing field has its type's zero.
PAYLOAD = StructType(
    [StructField(n, StringType()) for n in ("type", "moment_id")]
    + [StructField(n, LongType()) for n in ("episode_id", "timestamp_ms", "t_end_ms")]
    + [StructField(n, StringType()) for n in ("thumb_path", "bbox", "label")]
    + [StructField(n, DoubleType()) for n in ("yolo_conf", "verify_cos")]
    + [StructField(n, StringType()) for n in ("text", "thumb_b64")]
    + [StructField("synced", BooleanType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, rounded down, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000)).cast("long")


def class_name(index: Column) -> Column:
    """COCO name; "unknown" out of range (SRC7)."""
    return F.coalesce(F.get(F.array(*map(F.lit, COCO_NAMES)), index.cast("int")), F.lit("unknown"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection: a frame, three regions and a line of text for each moment; all share the moment's time and episode."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("clip"), F.col("label").alias("class_id"))
    events = table(spark, sf_dir, "events")
    # one vector for each class name: a bounded dictionary
    anchors = vectors.groupBy("class_id").agg(F.min_by("clip", "id").alias("anchor"))
    place = F.pmod(F.col("id"), F.lit(5))
    kind = F.when(place == 0, "frame").when(place == 4, "ocr").otherwise("region")
    own = events.select(F.col("event_id").alias("id"), "value")
    parent = events.select(F.col("event_id").alias("moment_id"), epoch_ms(F.col("ts")).alias("timestamp_ms"), F.col("user_id").alias("episode_id"))
    base = vectors.withColumn("moment_id", F.col("id") - place).withColumn("type", kind)
    base = base.join(own, "id").join(parent, "moment_id").join(anchors, "class_id")
    region = F.col("type") == "region"
    conf = F.when(region, F.round(F.least(F.lit(1.0), F.col("value") / 500.0), 4)).otherwise(0.0)
    verify = F.when(region, F.round(dot(F.col("clip"), F.col("anchor")), 6)).otherwise(0.0)
    left, top = F.pmod("id", F.lit(10)) / 20.0, F.pmod("id", F.lit(7)) / 14.0
    box = F.format_string("%.3f,%.3f,%.3f,%.3f", left, top, left + 0.3, top + 0.25)
    third = F.pmod("id", F.lit(3))
    return base.select(
        "id",
        "moment_id",
        "type",
        "episode_id",
        "timestamp_ms",
        F.col("timestamp_ms").alias("t_end_ms"),
        "clip",
        F.when(region & (verify >= VERIFY_GATE), class_name(F.col("class_id"))).otherwise("").alias("label"),
        conf.alias("yolo_conf"),
        verify.alias("verify_cos"),
        F.when(region, box).otherwise("").alias("bbox"),
        F.when(F.col("type") != "ocr", F.concat(F.lit("/thumbs/moment_"), "moment_id", F.lit(".jpg"))).otherwise("").alias("thumb_path"),
        F.when(third == 0, True).when(third == 1, False).alias("synced"),
        (F.pmod("id", F.lit(4)) == 0).alias("curated"),
        class_name(F.col("class_id")).alias("class_name"),
        "class_id",
    )


def payload_json(row: DataFrame) -> Column:
    """The payload of a point as JSON; absent values are left out."""
    names = [f.name for f in PAYLOAD if f.name in row.columns]
    return F.to_json(F.struct(*[F.col(n).cast("string").alias(n) if n == "moment_id" else F.col(n) for n in names]))


def is_object(payload: Column) -> Column:
    """Whether a payload is a well-formed JSON object."""
    return F.coalesce((F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT")), F.lit(False))


def payload_tolerant(payload: Column) -> Column:
    """The typed payload; what is missing, of another type or malformed has its type's zero (PRJ1)."""
    read = F.from_json(payload, PAYLOAD)
    zero = {StringType: F.lit(""), LongType: F.lit(0).cast("long"), DoubleType: F.lit(0.0), BooleanType: F.lit(False)}
    return F.struct(*[F.coalesce(read[f.name], zero[type(f.dataType)]).alias(f.name) for f in PAYLOAD])


def payload_strict(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with ``hit``, without the rows whose payload isn't a JSON object (PRJ2)."""
    return df.filter(is_object(F.col(payload))).withColumn("hit", payload_tolerant(F.col(payload)))


def regex_string(payload: Column, key: str) -> Column:
    """A string field by pattern alone, without escapes; '' if there is none (PRJ6)."""
    return F.regexp_extract(payload, f'"{key}"\\s*:\\s*"([^"]*)"', 1)


def regex_long(payload: Column, key: str) -> Column:
    return F.coalesce(F.regexp_extract(payload, f'"{key}"\\s*:\\s*(\\d+)', 1).try_cast("long"), F.lit(0).cast("long"))


def label_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``label`` and ``vector`` of a file of ``label<TAB>comma-separated numbers``; other lines are left out, a later line of a label wins (SRC6)."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = lines.select("line", F.split("value", "\t", 2).alias("p")).filter(F.size("p") == 2)
    read = parts.select("line", F.col("p")[0].alias("label"), F.transform(F.split(F.col("p")[1], ","), lambda x: F.trim(x).try_cast("double")).alias("vector"))
    good = read.filter((F.size("vector") == size) & F.forall("vector", lambda x: x.isNotNull()) & (F.col("label") != ""))
    return good.groupBy("label").agg(F.max_by("vector", "line").alias("vector"))
