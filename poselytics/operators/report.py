"""Final session reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poselytics.operators.lifecycle import SESSION_TIMEOUT_S


def session_reports(
    summaries: DataFrame, as_of_us: int | None = None, timeout_s: float = SESSION_TIMEOUT_S
) -> DataFrame:
    """Completed sessions name exercise and time of their last frame; others timed out.

    With ``as_of_us`` a session that is not complete and was active within the
    timeout is still running and gets no report.
    """
    if as_of_us is not None:
        silent = F.lit(as_of_us) - F.col("last_us") > round(timeout_s * 1_000_000)
        newest = F.max("session_instance").over(Window.partitionBy("session_uuid"))
        summaries = (
            summaries.withColumn("newest", newest)
            .filter(F.col("is_completing") | silent | (F.col("session_instance") < F.col("newest")))
            .drop("newest")
        )
    done = F.col("is_completing")
    return summaries.select(
        "session_uuid",
        "session_instance",
        F.when(done, F.lit("completed")).otherwise(F.lit("timeout")).alias("status"),
        F.when(done, F.col("last_exercise")).alias("exercise"),
        F.when(done, F.timestamp_micros("last_us")).alias("timestamp"),
        F.struct(
            "curr_state",
            "prev_state",
            F.filter(F.split("state_seq", ","), lambda s: s != "").alias("state_seq"),
            F.struct("correct", "incorrect").alias("curls"),
            F.struct(
                (F.col("inactive_us") / F.lit(1e6)).alias("inactive_time"),
                (F.col("inactive_front_us") / F.lit(1e6)).alias("inactive_time_front"),
            ).alias("timers"),
            F.struct("incorrect_posture", "critical_error").alias("flags"),
        ).alias("state"),
        F.struct("windows", "feedback_summary", "total_windows", "exercise_duration").alias("feedback"),
    )
