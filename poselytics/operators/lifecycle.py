"""Session lifecycle: idle gaps, completion, and re-opening as a new instance."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.operators.classify import ORDER, order_key
from poselytics.operators.reset_map import MAX_PIECES
from poselytics.operators.ordered_scan import Chunked, chunk_rows, ordered_scan

SESSION_TIMEOUT_S = 300.0
PROCESSING_DELAY_S = 10.0

_FAR = np.iinfo(np.int64).max


@dataclass(slots=True)
class LifecycleState:
    instance: int
    epoch: int
    last_us: int
    completed_us: int | None  # first completing frame of the instance
    exercise: str  # of the instance's first frame
    level: int

    def step(
        self, ts: int, complete: bool, exercise: str, level: int, timeout: int, grace: int, ttl: int
    ) -> None:
        """Move on to a frame (times in microseconds). Batch and streaming share this."""
        gap = ts - self.last_us
        self.last_us = ts
        if gap > ttl:
            self.epoch += 1
        completed = self.completed_us
        if gap > timeout or (completed is not None and ts > completed + grace):
            self.instance += 1
            self.completed_us = completed = None
            self.exercise, self.level = exercise, level
        if complete and completed is None:
            self.completed_us = ts


#: Exercise and level of the frame that opened an instance.
_Kind = tuple[str, int]

#: Completion pending at the end, instances opened on the way, and the kind of the last of them.
_Exit = tuple[int | None, int, _Kind | None]


class _Transfer(NamedTuple):
    first_us: int
    last_us: int
    exercise: str
    level: int
    epochs: int
    completing: list[int]  # running max time at completing frames, ascending
    exits: list[_Exit]
    truncated: bool
    opening: list[int]  # running max time at the last frame of each run of one kind, ascending
    kinds: list[_Kind]
    latest: int  # running max time at the end of the leading block
    idle: _Exit  # exit when no completion is pending at entry
    tail: _Exit | None  # from the first long gap on


class LifecycleMachine:
    """Splits a session where it is silent too long, or goes on after completing.

    Frames up to ``grace`` after the first completing frame still belong to the
    instance, as they would be in the same processing batch. ``ttl`` starts a new
    state epoch after a shorter silence.
    """

    inputs = ["ts_us", "is_complete", "exercise", "level"]
    outputs = [
        ("session_instance", pa.int32()),
        ("state_epoch", pa.int32()),
        ("prev_us", pa.int64()),
        ("completed_us", pa.int64()),
        ("session_exercise", pa.string()),
        ("session_level", pa.int32()),
    ]

    def __init__(
        self,
        timeout_s: float = SESSION_TIMEOUT_S,
        grace_s: float = PROCESSING_DELAY_S,
        state_ttl_s: float | None = None,
    ):
        self.timeout = round(timeout_s * 1_000_000)
        self.grace = round(grace_s * 1_000_000)
        self.ttl = _FAR if state_ttl_s is None else round(state_ttl_s * 1_000_000)

    def run(self, state, rows, lo, hi, out):
        times, complete = rows["ts_us"][lo:hi], rows["is_complete"][lo:hi]
        previous: list[int | None] = [None if state is None else state.last_us, *times[:-1]]
        if state is None:
            state = LifecycleState(0, 0, times[0], None, rows["exercise"][lo], rows["level"][lo])
        else:
            state = replace(state)
        instances, epochs, completed, exercises, levels = [], [], [], [], []
        for ts, done, exercise, level in zip(times, complete, rows["exercise"][lo:hi], rows["level"][lo:hi]):
            state.step(ts, done, exercise, level, self.timeout, self.grace, self.ttl)
            instances.append(state.instance)
            epochs.append(state.epoch)
            completed.append(state.completed_us)
            exercises.append(state.exercise)
            levels.append(state.level)
        if out is not None:
            added = (instances, epochs, previous, completed, exercises, levels)
            for (name, _), values in zip(self.outputs, added):
                out[name].extend(values)
        return state

    def transfer(self, rows) -> _Transfer:
        times = np.asarray(rows["ts_us"], dtype=np.int64)
        complete = np.asarray(rows["is_complete"], dtype=bool)
        gaps = np.diff(times)
        long_gaps = np.flatnonzero(gaps > self.timeout)
        end = int(long_gaps[0]) + 1 if len(long_gaps) else len(times)
        tail = None
        if end < len(times):
            start = LifecycleState(0, 0, int(times[end - 1]), None, "", 0)
            left = self.run(start, rows, end, len(times), None)
            tail = (left.completed_us, left.instance, (left.exercise, left.level))
        highs = np.maximum.accumulate(times[:end])
        marks = np.flatnonzero(complete[:end])
        exits: list[_Exit] = [(None, 0, None)] * len(marks)
        # the frame that re-opens the session, and the next completion from there on
        reopen = np.searchsorted(highs, times[marks] + self.grace, side="right")
        following = np.searchsorted(marks, reopen).tolist()
        for k in range(len(marks) - 1, -1, -1):
            if reopen[k] == end:
                exits[k] = (int(times[marks[k]]), 0, None)
                continue
            opened = rows["exercise"][reopen[k]], rows["level"][reopen[k]]
            if following[k] == len(marks):
                exits[k] = (None, 1, opened)
            else:
                completed, splits, last = exits[following[k]]
                exits[k] = (completed, splits + 1, last or opened)
        completing: list[int] = []
        kept: list[_Exit] = []
        truncated = False
        for high, left in zip(highs[marks].tolist(), exits):
            if kept and kept[-1] == left:
                completing[-1] = high
                continue
            # a completion pending at entry lies before this chunk, so its grace ends early
            if len(kept) == MAX_PIECES or (completing and completing[-1] > times[0] + 2 * self.grace):
                truncated = True
                break
            completing.append(high)
            kept.append(left)
        opening, kinds = self._openings(rows, highs)
        return _Transfer(
            int(times[0]),
            int(times[-1]),
            rows["exercise"][0],
            rows["level"][0],
            int((gaps > self.ttl).sum()),
            completing,
            kept,
            truncated,
            opening,
            kinds,
            int(highs[-1]),
            exits[0] if exits else (None, 0, None),
            tail,
        )

    @staticmethod
    def _openings(rows, highs: np.ndarray) -> tuple[list[int], list[_Kind]]:
        """What the frame that first goes beyond a time is of; only frames later than all before can be it."""
        later = np.flatnonzero(np.diff(highs, prepend=highs[0] - 1) > 0).tolist()
        opening: list[int] = []
        kinds: list[_Kind] = []
        for at in later:
            kind = rows["exercise"][at], rows["level"][at]
            if kinds and kinds[-1] == kind:
                opening[-1] = int(highs[at])
                continue
            if len(kinds) == MAX_PIECES:
                break
            opening.append(int(highs[at]))
            kinds.append(kind)
        return opening, kinds

    def apply(self, transfer: _Transfer, state: LifecycleState | None) -> LifecycleState | None:
        t = transfer
        if state is None:
            state = LifecycleState(0, 0, t.first_us, None, t.exercise, t.level)
        instance, epoch, completed = state.instance, state.epoch, state.completed_us
        kind = state.exercise, state.level
        gap = t.first_us - state.last_us
        epoch += t.epochs + (gap > self.ttl)
        if gap > self.timeout:
            instance, completed, kind = instance + 1, None, (t.exercise, t.level)
        opened = None
        if completed is None:
            completed, splits, opened = t.idle
        elif t.latest <= completed + self.grace:
            splits = 0
        else:
            first = bisect_right(t.opening, completed + self.grace)
            if first == len(t.kinds):
                return None
            piece = bisect_right(t.completing, completed + self.grace)
            if piece == len(t.exits) and t.truncated:
                return None
            completed, splits, opened = t.exits[piece] if piece < len(t.exits) else (None, 0, None)
            splits, opened = splits + 1, opened or t.kinds[first]
        instance += splits
        kind = opened or kind
        if t.tail is not None:
            completed, more, kind = t.tail
            instance += more
        return LifecycleState(instance, epoch, t.last_us, completed, *kind)


def order_frames(compact: DataFrame, n_chunks: int | None = None) -> Chunked:
    """Frames in replay order, a session spread over as many chunks as it fills."""
    return chunk_rows(compact, "session_uuid", ORDER, n_chunks)


def with_lifecycle(ordered: Chunked, **options: float | None) -> Chunked:
    """Add ``session_instance, state_epoch, prev_us, session_exercise, session_level``."""
    return ordered_scan(ordered, ["session_uuid"], LifecycleMachine(**options))


def idle_gaps(tracked: DataFrame, min_gap_s: float) -> DataFrame:
    """Silences longer than ``min_gap_s`` between consecutive frames of a session."""
    gap = F.col("ts_us") - F.col("prev_us")
    return tracked.filter(gap > round(min_gap_s * 1_000_000)).select(
        "session_uuid", "frame_track_uuid", "prev_us", "ts_us", gap.alias("gap_us")
    )


def session_lifecycle(tracked: DataFrame) -> DataFrame:
    """One row per session instance: span, size, completion and how it ended."""
    return (
        tracked.groupBy("session_uuid", "session_instance")
        .agg(
            F.count("*").alias("n_frames"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_active_us"),
            F.bool_or("is_complete").alias("is_completing"),
            F.max_by("exercise", order_key()).alias("last_exercise"),
        )
        .withColumn(
            "status", F.when(F.col("is_completing"), F.lit("completed")).otherwise(F.lit("timeout"))
        )
    )
