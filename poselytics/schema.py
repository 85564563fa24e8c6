"""Schemas of frames, catalog documents and model replies."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


LANDMARK = _struct(("x", DoubleType()), ("y", DoubleType()), ("z", DoubleType()), ("vis", DoubleType()))

ANGLE = _struct(
    ("name", StringType()),
    ("value", DoubleType()),
    ("point1", LANDMARK),
    ("point2", LANDMARK),
    ("ref_point", LANDMARK),
)

DOMINANT_SIDE = _struct(("side", StringType()), ("probability", DoubleType()))

METRICS = _struct(("angles", ArrayType(ANGLE)), ("dominant_side", DOMINANT_SIDE))

FRAME = _struct(
    ("frame_track_uuid", StringType()),
    ("timestamp", TimestampType()),
    ("exercise", StringType()),
    ("video_duration", DoubleType()),
    ("session_uuid", StringType()),
    ("landmarks", ArrayType(LANDMARK)),
    ("metrics", METRICS),
    ("current_time", DoubleType()),
)

# on the wire the time is ISO-8601 text and the scalars may be quoted; the side is
# kept as a map to see whether its nullable key is there
FRAME_WIRE = _struct(
    ("frame_track_uuid", StringType()),
    ("timestamp", StringType()),
    ("exercise", StringType()),
    ("video_duration", StringType()),
    ("session_uuid", StringType()),
    ("landmarks", ArrayType(LANDMARK)),
    (
        "metrics",
        _struct(("angles", ArrayType(ANGLE)), ("dominant_side", MapType(StringType(), StringType()))),
    ),
    ("current_time", StringType()),
)

# every key must be present; only these may hold null
FRAME_NULLABLE = ["video_duration", "current_time"]

_LEVEL_STATES = _struct(
    ("states", ArrayType(_struct(("id", StringType()), ("condition", StringType())))),
    ("success_sequence", ArrayType(StringType())),
)

_THRESHOLD = _struct(
    ("min", DoubleType()),
    ("max", DoubleType()),
    ("feedback", StringType()),
    ("critical", BooleanType()),
)

_LEVEL_THRESHOLDS = _struct(
    ("angle_thresh", MapType(StringType(), ArrayType(_THRESHOLD))),
    ("OFFSET_THRESH", DoubleType()),
    ("INACTIVE_THRESH", DoubleType()),
)

_MESSAGE = _struct(
    ("id", StringType()),
    ("message", StringType()),
    ("color", StringType()),
    ("severity", StringType()),
)

CATALOG_DOC = _struct(
    ("exercise_name", StringType()),
    ("dominant_side_points", ArrayType(StringType())),
    ("landmark_features_dict", MapType(StringType(), ArrayType(StringType()))),
    ("angles", ArrayType(_struct(("name", StringType())))),
    ("state_machine", MapType(StringType(), _LEVEL_STATES)),
    ("thresholds", MapType(StringType(), _LEVEL_THRESHOLDS)),
    ("feedback_messages", ArrayType(_MESSAGE)),
    ("inactivity_time", IntegerType()),
)

# the reply a caller-supplied scorer is asked to give
ANALYSIS = _struct(
    (
        "safety_analysis",
        _struct(
            ("status", StringType()),
            ("risk_level", IntegerType()),
            ("critical_corrections", ArrayType(StringType())),
        ),
    ),
    (
        "performance_analysis",
        _struct(
            ("quality_score", IntegerType()),
            (
                "main_issues",
                ArrayType(
                    _struct(
                        ("issue", StringType()),
                        ("severity", StringType()),
                        ("description", StringType()),
                    )
                ),
            ),
            ("progress_evaluation", StringType()),
        ),
    ),
    (
        "recommendations",
        _struct(
            ("critical_corrections", ArrayType(StringType())),
            ("improvement_suggestions", ArrayType(StringType())),
            ("future_session_tips", ArrayType(StringType())),
        ),
    ),
    ("reasoning", StringType()),
)
