"""The whole analysis of a frames table in one call."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poselytics.operators.buffer import dedup_frames
from poselytics.operators.classify import compact_frames
from poselytics.operators.feedback import (
    MIN_FRAME_RATIO,
    exercise_summary,
    feedback_summary,
    feedback_windows,
)
from poselytics.operators.lifecycle import (
    PROCESSING_DELAY_S,
    SESSION_TIMEOUT_S,
    order_frames,
    session_lifecycle,
    with_lifecycle,
)
from poselytics.operators.report import session_reports
from poselytics.operators.session_fold import (
    WINDOW_S,
    rep_events,
    reset_events,
    session_states,
    session_trace,
    trace_rejects,
)
from poselytics.session import configure, materialise
from poselytics.sources.catalog import Catalog

#: Columns of a frame that the analysis reads, besides the angles.
ANALYSED = ["session_uuid", "frame_track_uuid", "timestamp", "exercise", "current_time", "video_duration"]


class SessionAnalysis:
    """Valid frames to repetitions, feedback windows and session reports.

    The frames are shuffled once (twice with ``dedup``: identical frames count
    once). The ordered frames and the folded trace are written to the shared
    folder, so every result reads the trace and nothing is folded twice.
    """

    def __init__(
        self,
        frames: DataFrame,
        catalog: Catalog,
        level: int | Column = 0,
        dedup: bool = True,
        timeout_s: float = SESSION_TIMEOUT_S,
        grace_s: float = PROCESSING_DELAY_S,
        state_ttl_s: float | None = None,
        window_s: float = WINDOW_S,
        min_frame_ratio: float = MIN_FRAME_RATIO,
        n_chunks: int | None = None,
    ):
        configure(frames.sparkSession)
        self.catalog = catalog
        self.timeout_s = timeout_s
        self.window_s = window_s
        self.min_frame_ratio = min_frame_ratio
        if dedup:
            given = F.lit(level) if isinstance(level, int) else level
            angles = F.struct(F.col("metrics.angles").alias("angles")).alias("metrics")
            frames = dedup_frames(frames, [*ANALYSED, angles, given.alias("level")])
            level = F.col("level")
        ordered = order_frames(compact_frames(frames, level), n_chunks)
        self.tracked = with_lifecycle(
            ordered, timeout_s=timeout_s, grace_s=grace_s, state_ttl_s=state_ttl_s
        )

    @cached_property
    def trace(self) -> DataFrame:
        return materialise(session_trace(self.tracked, self.catalog, self.window_s))

    @property
    def rejects(self) -> DataFrame:
        """Frames without rules or without an angle these need; with ``trace`` they are all frames."""
        return trace_rejects(self.tracked, self.catalog)

    @property
    def lifecycle(self) -> DataFrame:
        return session_lifecycle(self.tracked.df)

    @property
    def reps(self) -> DataFrame:
        return rep_events(self.trace)

    @property
    def resets(self) -> DataFrame:
        return reset_events(self.trace)

    @property
    def states(self) -> DataFrame:
        return session_states(self.trace)

    @property
    def windows(self) -> DataFrame:
        return feedback_windows(self.trace, self.window_s, self.min_frame_ratio)

    @property
    def feedback(self) -> DataFrame:
        return feedback_summary(self.windows)

    @property
    def summaries(self) -> DataFrame:
        return exercise_summary(self.states, self.windows)

    def reports(self, as_of_us: int | None = None) -> DataFrame:
        return session_reports(self.summaries, as_of_us, self.timeout_s)
