"""Frames derived from an ``events`` table: one user is one session.

Event time is compressed 36,000 times, so 30 days become 72 seconds. The
constants are exactly representable, so another SQL engine agrees bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poselytics.schema import ANGLE, FRAME, LANDMARK

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 UTC
COMPRESSION = 36_000


def events_frames(spark: SparkSession, sf_dir: str, exercise: str | None = "dumbbell-arm") -> DataFrame:
    """Canonical frames plus a ``level`` column; ``exercise=None`` keeps the event type."""
    return frames_of(spark.read.parquet(f"{sf_dir}/events.parquet"), exercise)


def frames_of(events: DataFrame, exercise: str | None) -> DataFrame:
    frame_us = F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div {COMPRESSION}")
    # a message never carries a null angle or time
    present = events.filter(
        F.col("ts").isNotNull() & F.col("user_id").isNotNull() & F.col("value").isNotNull()
    )

    def named(name: str, value: object) -> object:
        return F.struct(
            F.lit(name).alias("name"),
            value.alias("value"),
            *[F.lit(None).cast(LANDMARK).alias(p) for p in ("point1", "point2", "ref_point")],
        ).cast(ANGLE)

    k = F.get_json_object("props", "$.k").cast("double")
    return present.select(
        F.concat(F.lit("f-"), F.col("event_id")).alias("frame_track_uuid"),
        F.timestamp_micros(frame_us + F.lit(EPOCH_US)).alias("timestamp"),
        (F.lit(exercise) if exercise else F.col("event_type")).alias("exercise"),
        (F.lit(50) + F.col("user_id") % 40).cast("double").alias("video_duration"),
        F.concat(F.lit("sess-"), F.col("user_id")).alias("session_uuid"),
        F.array().cast(FRAME["landmarks"].dataType).alias("landmarks"),
        F.struct(
            F.array(
                named("elbow_angle", F.lit(20.0) + F.lit(1.5) * k),
                named("shoulder_angle", F.col("value") % 60),
                named("offset_angle", F.col("value") * F.lit(0.25)),
            ).alias("angles"),
            F.struct(
                F.lit("right").alias("side"), F.lit(None).cast("double").alias("probability")
            ).alias("dominant_side"),
        ).alias("metrics"),
        (frame_us / F.lit(1e6)).alias("current_time"),
        (F.col("user_id") % 2).cast("int").alias("level"),
    )
