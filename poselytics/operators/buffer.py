"""Frame buffer queries: de-duplication, retention, ranges and incremental consumption."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poselytics.operators.classify import order_key
from poselytics.operators.ordered_scan import chunk_rows, ordered_scan

RETENTION_S = 30
PROCESSING_WINDOW_S = 10


def dedup_frames(frames: DataFrame, keep: list[str | Column] | None = None) -> DataFrame:
    """Identical frames collapse to one; copies are merged before the shuffle.

    With ``keep`` only these columns come back. Frames are still compared as a whole: the columns that are not named
    stand in 128 bits of their JSON taken at the scan, so landmarks and whatever else is not kept are never shuffled.
    """
    if keep is None:
        return frames.dropDuplicates()
    rest = F.struct(*[F.col(f"`{c}`") for c in frames.columns if c not in [k for k in keep if isinstance(k, str)]])
    digest = F.unhex(F.md5(F.to_json(rest, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})))
    return frames.select(*keep, digest.alias("frame_digest")).dropDuplicates().drop("frame_digest")


class RetentionMachine:
    """Newest time among the frames that arrived later (rows come latest first)."""

    inputs = ["ts_ms"]
    outputs = [("is_evicted", pa.bool_())]

    def __init__(self, retention_ms: int):
        self.retention = retention_ms

    def run(self, state, rows, lo, hi, out):
        if lo == hi:
            return state
        times = np.asarray(rows["ts_ms"][lo:hi], dtype=np.int64)
        newest = np.maximum.accumulate(times if state is None else np.concatenate(([state], times)))
        if out is not None:
            later = newest[:-1]  # before each row, but for a first one without any
            judged = times[len(times) - len(later) :]
            evicted = (judged >= 0) & (judged <= later - self.retention)
            out["is_evicted"].extend([False] * (len(times) - len(later)) + evicted.tolist())
        return int(newest[-1])

    def transfer(self, rows):
        return max(rows["ts_ms"])

    def apply(self, transfer, state):
        return transfer if state is None else max(state, transfer)


def retention(
    arrivals: DataFrame, retention_s: float = RETENTION_S, n_chunks: int | None = None
) -> DataFrame:
    """Mark frames evicted by a later arrival that is ``retention_s`` or more newer.

    Needs ``session_uuid, ts_ms, arrival_seq``.
    """
    latest_first = chunk_rows(arrivals, "session_uuid", [F.desc("arrival_seq")], n_chunks)
    machine = RetentionMachine(round(retention_s * 1000))
    return ordered_scan(latest_first, ["session_uuid"], machine).df.drop("chunk")


def frames_between(frames: DataFrame, start: Column, end: Column, session: str | None = None) -> DataFrame:
    """Frames with ``start <= timestamp <= end``; the range reaches the Parquet scan."""
    found = frames.filter(F.col("timestamp").between(start, end))
    return found if session is None else found.filter(F.col("session_uuid") == session)


def _with_cursor(frames: DataFrame, cursors: DataFrame) -> DataFrame:
    """Frames with their session's last consumed ms (0 if none). Skew is left to AQE."""
    joined = frames.join(cursors.select("session_uuid", "last_ms"), "session_uuid", "left")
    return joined.withColumn("last_ms", F.coalesce("last_ms", F.lit(0).cast("bigint")))


def _due(as_of_ms: int, window_s: float) -> Column:
    return F.col("ts_ms").between(F.col("last_ms") + 1, F.lit(as_of_ms - round(window_s * 1000)))


def consume(
    frames: DataFrame, cursors: DataFrame, as_of_ms: int, window_s: float = PROCESSING_WINDOW_S
) -> DataFrame:
    """Frames newer than their session's cursor and older than the processing window."""
    return _with_cursor(frames, cursors).filter(_due(as_of_ms, window_s)).drop("last_ms")


def remaining(
    frames: DataFrame, cursors: DataFrame, as_of_ms: int, window_s: float = PROCESSING_WINDOW_S
) -> DataFrame:
    """What consuming leaves in the buffer: late frames and those not due yet."""
    return _with_cursor(frames, cursors).filter(~_due(as_of_ms, window_s)).drop("last_ms")


def advance_cursors(
    consumed: DataFrame, cursors: DataFrame, as_of_ms: int, window_s: float = PROCESSING_WINDOW_S
) -> DataFrame:
    """Cursors after a cycle: they move only where frames were found."""
    moved = consumed.select(
        "session_uuid", F.lit(as_of_ms - round(window_s * 1000)).cast("bigint").alias("last_ms")
    )
    return (
        cursors.select("session_uuid", "last_ms")
        .unionByName(moved.distinct())
        .groupBy("session_uuid")
        .agg(F.max("last_ms").alias("last_ms"))
    )


def late_frames(frames: DataFrame, cursors: DataFrame) -> DataFrame:
    """Frames at or before their session's cursor: they are never consumed."""
    return _with_cursor(frames, cursors).filter(F.col("ts_ms") <= F.col("last_ms"))


def active_sessions(frames: DataFrame) -> DataFrame:
    return frames.select("session_uuid").distinct()


def latest_frames(frames: DataFrame) -> DataFrame:
    """Latest frame per session in replay order, as struct ``frame``.

    The newest time of each session comes first, a number that is hashed without sorting; only frames of
    that very time go on to the comparison by id. Whether the times are broadcast to the frames is left to their size.
    """
    newest = frames.groupBy(F.col("session_uuid").alias("newest_of")).agg(F.max("ts_ms").alias("newest_ms"))
    same = F.col("session_uuid").eqNullSafe(F.col("newest_of")) & F.col("ts_ms").eqNullSafe(F.col("newest_ms"))
    tied = frames.join(newest, same, "left_semi")
    return tied.groupBy("session_uuid").agg(F.max_by(F.struct("*"), order_key()).alias("frame"))


def clean_old_frames(frames: DataFrame, as_of_ms: int, max_age_s: float) -> DataFrame:
    """Keep frames younger than ``max_age_s`` at ``as_of_ms``."""
    return frames.filter(F.col("ts_ms") > as_of_ms - round(max_age_s * 1000))
