"""Pose frames: JSON decode, validation, rejects, batch and stream readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from poselytics.schema import FRAME, FRAME_NULLABLE, FRAME_WIRE
from poselytics.sources.catalog import Catalog


def _first_reason(reasons: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in reasons])


def _invalid_landmark(mark: Column) -> Column:
    return mark.isNull() | mark["x"].isNull() | mark["y"].isNull()


def _invalid_angle(a: Column) -> Column:
    result = a.isNull() | a["name"].isNull() | a["value"].isNull()
    for point in ("point1", "point2", "ref_point"):
        result = result | _invalid_landmark(a[point])
    return result


def parse_frames(messages: DataFrame, value: str = "value") -> DataFrame:
    """Decode JSON text into frame columns plus ``reject_reason`` (NULL when valid).

    Reasons: ``bad_json`` (not a JSON object), ``missing_<field>`` (no such key) and
    ``invalid_<field>`` (unusable value, or null where one is needed).
    """
    # a generator row decodes each message once: later filters and projections
    # cannot be merged into it and repeat the work per field
    decoded = messages.select(F.col(value).cast("string").alias("raw")).select(
        "raw",
        F.inline(
            F.array(F.struct(F.from_json("raw", FRAME_WIRE).alias("f"), F.json_object_keys("raw").alias("keys")))
        ),
    )
    side = F.col("f.metrics.dominant_side")
    typed = decoded.select(
        "raw",
        "keys",
        "f",
        F.try_to_timestamp("f.timestamp").alias("timestamp"),
        F.col("f.video_duration").try_cast("double").alias("video_duration"),
        F.col("f.current_time").try_cast("double").alias("current_time"),
    )
    reasons: list[tuple[Column, str]] = [(F.col("keys").isNull(), "bad_json")]
    for name in FRAME.fieldNames():
        reasons.append((~F.array_contains("keys", name), f"missing_{name}"))
    for name in FRAME.fieldNames():
        if name in FRAME_NULLABLE:
            unusable = F.col(name).isNull() & F.col(f"f.{name}").isNotNull()
        else:
            unusable = F.col("timestamp" if name == "timestamp" else f"f.{name}").isNull()
        reasons.append((unusable, f"invalid_{name}"))
    reasons += [
        (F.exists("f.landmarks", _invalid_landmark), "invalid_landmarks"),
        (
            F.col("f.metrics.angles").isNull()
            | F.exists("f.metrics.angles", _invalid_angle)
            | side["side"].isNull()
            | ~F.coalesce(F.map_contains_key(side, "probability"), F.lit(False))
            | (side["probability"].isNotNull() & side["probability"].try_cast("double").isNull()),
            "invalid_metrics",
        ),
    ]
    metrics = F.struct(
        F.col("f.metrics.angles").alias("angles"),
        F.struct(
            side["side"].alias("side"), side["probability"].try_cast("double").alias("probability")
        ).alias("dominant_side"),
    )
    own = {"metrics": metrics} | {n: F.col(n) for n in ("timestamp", "video_duration", "current_time")}
    return typed.select(
        *[own.get(name, F.col(f"f.{name}")).alias(name) for name in FRAME.fieldNames()],
        "raw",
        _first_reason(reasons).alias("reject_reason"),
    )


def valid_frames(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).select(*FRAME.fieldNames())


def rejected_frames(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull()).select("raw", "reject_reason")


def unknown_exercise(frames: DataFrame, catalog: Catalog) -> DataFrame:
    """Frames whose exercise has no valid catalog document."""
    known = F.broadcast(catalog.rule_table().select("exercise").distinct())
    return frames.join(known, "exercise", "left_anti")


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Already typed frames from files (Parquet, ORC, JSON lines)."""
    return spark.read.schema(FRAME).format(fmt).load(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON messages, one per line, as ``value``."""
    return spark.read.text(path)


def stream_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw JSON messages from a growing folder, as ``value``."""
    reader: DataStreamReader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None
) -> DataFrame:
    """Raw JSON messages from a topic, from its earliest offset, as ``value``."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()
