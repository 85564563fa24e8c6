"""Sessions as a stream: ordered release, keyed state, timers and reports.

Frames of a micro-batch arrive in any order. They wait in the session's state, a few in
its record and more in buckets of event time, until the watermark passes them, are then folded in replay order by the same
step functions as the batch engine, and leave as events of four kinds:
``rep``, ``window``, ``report`` and ``reject`` (a frame that the rules cannot judge, at once).
The sequence and limit a session goes by come with its frames, so rules may change while it runs.

Python is given a frame, and gives an event, as one JSON text: what pandas and Arrow cost is
by columns and by sessions, not by rows, and a session has few rows in a micro-batch.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from poselytics.operators.classify import classify, compact_frames
from poselytics.operators.feedback import MIN_FRAME_RATIO
from poselytics.operators.lifecycle import PROCESSING_DELAY_S, SESSION_TIMEOUT_S, LifecycleState
from poselytics.operators.session_fold import WINDOW_S, SessionState
from poselytics.sources.catalog import Catalog

# a closed session is forgotten after this much event time, but for the number of its next instance
FORGET_AFTER_S = 6000.0
# and that after this much
TOMBSTONE_S = 30 * 86_400.0
# event time of the frames that wait together
BUCKET_S = 10.0
# frames that wait in the record itself; each call of the state costs as much as folding many frames
NEAR = 128
# closed windows that do so
NEAR_WINDOWS = 32
# events of a session in memory before they leave
HELD = 1000

_FRAME_COLUMNS = (
    "ts_ms",
    "frame_track_uuid",
    "ts_us",
    "exercise",
    "level",
    "is_complete",
    "bad_posture",
    "state",
    "feedback_ids",
    "critical",
    "success",
    "inactive_us",
)
_REJECT_COLUMNS = ("ts_us", "frame_track_uuid", "exercise", "reject_reason")

_EVENT_FIELDS = {
    "kind": "string",
    "session_uuid": "string",
    "session_instance": "int",
    "ts_us": "bigint",
    "frame_track_uuid": "string",
    "rep": "string",
    "start_us": "bigint",
    "end_us": "bigint",
    "feedback": "array<struct<id:string,count:bigint,frame_ratio:double>>",
    "status": "string",
    "exercise": "string",
    "correct": "bigint",
    "incorrect": "bigint",
    "total_windows": "bigint",
    "exercise_duration": "double",
    "feedback_summary": (
        "array<struct<id:string,windows_count:bigint,total_occurrences:bigint,window_ratio:double>>"
    ),
    "windows": (
        "array<struct<start_us:bigint,end_us:bigint,feedback:array<struct<id:string,count:bigint,frame_ratio:double>>>>"
    ),
    "state": (
        "struct<curr_state:string,prev_state:string,state_seq:array<string>,"
        "curls:struct<correct:bigint,incorrect:bigint>,"
        "timers:struct<inactive_time:double,inactive_time_front:double>,"
        "flags:struct<incorrect_posture:boolean,critical_error:boolean>>"
    ),
    "n_frames": "bigint",
    "reject_reason": "string",
}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


EVENT_SCHEMA = _ddl(_EVENT_FIELDS)


@dataclass(slots=True)
class SessionRecord:
    """What is kept per session between micro-batches, apart from many waiting frames."""

    life: LifecycleState | None = None
    fold: SessionState = field(default_factory=SessionState)
    counts: dict[str, int] = field(default_factory=dict)  # of the active window, first seen first
    issues: dict[str, list[int]] = field(default_factory=dict)  # id -> [windows, occurrences]
    windows: int = 0
    first_start_us: int | None = None
    last_end_us: int | None = None
    last_exercise: str | None = None
    success: tuple[str, ...] = ()  # of the frame that opened the instance, with the limit
    limit: int = 0
    frames: int = 0  # of the instance
    reported: bool = False
    timer_ms: int | None = None
    near: list[tuple[int, str]] = field(default_factory=list)  # waiting frames, with their ms
    buckets: set[int] = field(default_factory=set)  # in which others wait
    closed: list[dict] = field(default_factory=list)  # the latest closed windows
    stored: bool = False  # earlier ones are in the state

    def start_afresh(self) -> None:
        self.fold = SessionState()
        self.counts, self.issues, self.closed = {}, {}, []
        self.windows = 0
        self.first_start_us = self.last_end_us = None
        self.reported = False


class SessionProcessor(StatefulProcessor):
    def __init__(
        self,
        window_s: float = WINDOW_S,
        min_frame_ratio: float = MIN_FRAME_RATIO,
        timeout_s: float = SESSION_TIMEOUT_S,
        grace_s: float = PROCESSING_DELAY_S,
        state_ttl_s: float | None = None,
        forget_after_s: float = FORGET_AFTER_S,
        tombstone_s: float = TOMBSTONE_S,
        bucket_s: float = BUCKET_S,
        near: int = NEAR,
    ):
        self.window = round(window_s * 1_000_000)
        self.min_frame_ratio = min_frame_ratio
        self.timeout = round(timeout_s * 1_000_000)
        self.grace = round(grace_s * 1_000_000)
        # a silence above the timeout opens a new instance anyway
        self.ttl = self.timeout if state_ttl_s is None else round(state_ttl_s * 1_000_000)
        self.forget = round(forget_after_s * 1_000_000)
        self.tombstone_ms = round(tombstone_s * 1000)
        self.bucket_ms = round(bucket_s * 1000)
        self.near = near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint", "blob binary")
        self.windows = handle.getListState("windows", "blob binary")
        self.record = handle.getValueState("record", "blob binary")
        # of a session that was forgotten: its next instance, and when that is forgotten too
        self.tombstone = handle.getValueState("tombstone", "instance int, until_ms bigint")

    def close(self) -> None:
        pass

    def _load(self) -> SessionRecord:
        found = self.record.get()
        return SessionRecord() if found is None else pickle.loads(bytes(found[0]))

    def _save(self, record: SessionRecord) -> None:
        self.record.update((pickle.dumps(record),))

    def _set_timer(self, record: SessionRecord, at_ms: int | None, fired: bool = False) -> None:
        """One timer per session: the earliest moment there is something to do."""
        if record.timer_ms == at_ms and not fired:
            return
        if record.timer_ms is not None and not fired:
            self.handle.deleteTimer(record.timer_ms)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)
        record.timer_ms = at_ms

    def _bucket(self, bucket: int) -> list[tuple[int, str]]:
        return pickle.loads(bytes(self.waiting.getValue((bucket,))[0]))

    def _by_bucket(self, frames: list[tuple[int, str]]) -> dict[int, list[tuple[int, str]]]:
        found: dict[int, list[tuple[int, str]]] = {}
        for frame in frames:
            found.setdefault(frame[0] // self.bucket_ms, []).append(frame)
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        record = self._load()
        due = record.timer_ms
        for batch in rows:
            rejects: list[dict] = []
            for ts_ms, rejected, text in zip(*(batch[c].tolist() for c in ("ts_ms", "rejected", "frame"))):
                if rejected:
                    rejects.append({"kind": "reject", "session_uuid": key[0], **json.loads(text)})
                else:
                    record.near.append((ts_ms, text))
                    due = ts_ms if due is None else min(due, ts_ms)
            if rejects:
                yield _events(rejects)
            if len(record.near) > self.near:
                for bucket, frames in self._by_bucket(record.near).items():
                    held = self._bucket(bucket) if bucket in record.buckets else []
                    self.waiting.updateValue((bucket,), (pickle.dumps(held + frames),))
                    record.buckets.add(bucket)
                record.near = []
        # a timer in the past fires with the next advance of the watermark
        if due is not None:
            self._set_timer(record, due)
            self._save(record)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        record = self._load()
        due = None
        events: list[dict] = []
        near = self._by_bucket(record.near)
        for bucket in sorted(record.buckets | near.keys()):
            if bucket * self.bucket_ms > now_ms:  # this one and those after it are not due
                due = bucket * self.bucket_ms
                break
            held = (self._bucket(bucket) if bucket in record.buckets else []) + near.pop(bucket, [])
            released = sorted((_frame(text) for ts_ms, text in held if ts_ms <= now_ms), key=lambda f: (f[0], f[1].encode(), f[2]))
            later = [(ts_ms, text) for ts_ms, text in held if ts_ms > now_ms]
            for frame in released:
                self._fold(record, key[0], frame, events)
            if len(record.closed) > NEAR_WINDOWS:
                self._keep_windows(record)
            if later:
                due = min(ts_ms for ts_ms, _ in later)
            if bucket not in record.buckets:
                near[bucket] = later
            elif later:
                self.waiting.updateValue((bucket,), (pickle.dumps(later),))
            else:
                self.waiting.removeKey((bucket,))
                record.buckets.remove(bucket)
            if len(events) >= HELD:
                yield _events(events)
                events = []
            if later:
                break
        record.near = [frame for frames in near.values() for frame in frames]
        end_ms = self._close(record, key[0], now_ms, events)
        if end_ms is None and due is None:
            self._forget(record, now_ms)
        else:
            at_ms = min(t for t in (due, end_ms) if t is not None)
            self._set_timer(record, at_ms, fired=True)
            self._save(record)
        if events:
            yield _events(events)

    def _forget(self, record: SessionRecord, now_ms: int) -> None:
        """Only the number of the next instance stays, for a time."""
        if record.life is not None:
            until = now_ms + self.tombstone_ms
            self.tombstone.update((record.life.instance + 1, until))
            self.handle.registerTimer(until + 1)
        elif self.tombstone.exists() and self.tombstone.get()[1] < now_ms:
            self.tombstone.clear()
        self.record.clear()
        self._drop_windows(record)

    def _keep_windows(self, record: SessionRecord) -> None:
        self.windows.appendList([(pickle.dumps(w),) for w in record.closed])
        record.closed, record.stored = [], True

    def _drop_windows(self, record: SessionRecord) -> None:
        if record.stored:
            self.windows.clear()
            record.stored = False

    def _close(self, record: SessionRecord, session: str, now_ms: int, events: list[dict]) -> int | None:
        """Report or forget the session if its time has come; else when that will be."""
        life = record.life
        if life is None:
            return None
        if not record.reported:
            ends = life.last_us + self.timeout
            if life.completed_us is not None:
                ends = min(ends, life.completed_us + self.grace)
            if now_ms * 1000 <= ends:
                return ends // 1000 + 1
            self._report(record, session, events)
        gone = life.last_us + self.forget
        return None if now_ms * 1000 > gone else gone // 1000 + 1

    def _fold(self, record: SessionRecord, session: str, frame: tuple, events: list[dict]) -> None:
        _, frame_id, ts, exercise, level, complete, bad, state, ids, critical, success, limit = frame
        opens = record.life is None
        if opens:
            found = self.tombstone.get()
            instance = 0 if found is None else found[0]
            record.life = LifecycleState(instance, 0, ts, ts if complete else None, exercise, level)
        else:
            life = record.life
            instance, epoch, completed = life.instance, life.epoch, life.completed_us
            life.step(ts, complete, exercise, level, self.timeout, self.grace, self.ttl)
            opens = life.instance != instance
            if opens and not record.reported:
                self._report(record, session, events, instance, completed)
            if opens or life.epoch != epoch:
                record.start_afresh()
                self._drop_windows(record)
        if opens:
            record.success, record.limit, record.frames = success, limit, 0
        life = record.life
        record.last_exercise = exercise
        record.frames += 1
        fold = record.fold
        rep, _, closed = fold.step(ts, bad, state, critical, record.success, record.limit, self.window)
        event = {"session_uuid": session, "session_instance": life.instance}
        if rep is not None:
            events.append({**event, "kind": "rep", "ts_us": ts, "frame_track_uuid": frame_id, "rep": rep})
        if closed is not None:
            self._close_window(record, event, closed, events)
        elif not bad:
            for id_ in ids:
                record.counts[id_] = record.counts.get(id_, 0) + 1

    def _close_window(self, record: SessionRecord, event: dict, start: int, events: list[dict]) -> None:
        total = sum(record.counts.values())
        kept = [
            {"id": id_, "count": n, "frame_ratio": n / total}
            for id_, n in record.counts.items()
            if n / total >= self.min_frame_ratio
        ]
        record.counts = {}
        if not total:
            return
        record.windows += 1
        record.last_end_us = start + self.window
        if record.first_start_us is None:
            record.first_start_us = start
        for issue in kept:
            sums = record.issues.setdefault(issue["id"], [0, 0])
            sums[0] += 1
            sums[1] += issue["count"]
        window = {"start_us": start, "end_us": record.last_end_us, "feedback": kept}
        record.closed.append(window)
        events.append({**event, "kind": "window", **window})

    def _report(
        self,
        record: SessionRecord,
        session: str,
        events: list[dict],
        instance: int | None = None,
        completed_us: int | None = None,
    ) -> None:
        """Final report of the running instance, or of the one just left (``instance``)."""
        life, fold = record.life, record.fold
        if instance is None:
            instance, completed_us = life.instance, life.completed_us
        done = completed_us is not None
        events.append(
            {
                "kind": "report",
                "session_uuid": session,
                "session_instance": instance,
                "status": "completed" if done else "timeout",
                "exercise": record.last_exercise if done else None,
                "ts_us": fold.last_us if done else None,
                "correct": fold.correct,
                "incorrect": fold.incorrect,
                "total_windows": record.windows,
                "exercise_duration": (record.last_end_us - record.first_start_us) / 1e6 if record.windows else None,
                "feedback_summary": [
                    {
                        "id": id_,
                        "windows_count": persisted,
                        "total_occurrences": occurrences,
                        "window_ratio": persisted / record.windows,
                    }
                    for id_, (persisted, occurrences) in record.issues.items()
                ],
                "windows": ([pickle.loads(bytes(blob)) for (blob,) in self.windows.get()] if record.stored else []) + record.closed,
                "state": {
                    "curr_state": fold.curr_state,
                    "prev_state": fold.prev_state,
                    "state_seq": list(fold.state_seq),
                    "curls": {"correct": fold.correct, "incorrect": fold.incorrect},
                    "timers": {
                        "inactive_time": fold.inactive_us / 1e6,
                        "inactive_time_front": fold.inactive_front_us / 1e6,
                    },
                    "flags": {"incorrect_posture": fold.incorrect_posture, "critical_error": fold.critical_error},
                },
                "n_frames": record.frames,
            }
        )
        record.reported = True


def _events(events: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({"event": [json.dumps(event) for event in events]})


def _frame(text: str) -> tuple:
    frame = json.loads(text)
    return (
        frame["ts_ms"],
        frame["frame_track_uuid"],
        frame["ts_us"],
        frame.get("exercise"),
        frame["level"],
        bool(frame.get("is_complete")),
        bool(frame.get("bad_posture")),
        frame.get("state"),
        frame["feedback_ids"],
        bool(frame.get("critical")),
        tuple(frame["success"]),
        frame["inactive_us"],
    )


def dedup_stream(frames: DataFrame, delay_s: float = PROCESSING_DELAY_S) -> DataFrame:
    """Drop identical frames that arrive within the watermark delay of each other."""
    return frames.withWatermark("timestamp", f"{delay_s} seconds").dropDuplicatesWithinWatermark()


def session_events(
    frames: DataFrame,
    catalog: Catalog,
    level: int | Column = 0,
    delay_s: float = PROCESSING_DELAY_S,
    watermarked: bool = False,
    **options: float,
) -> DataFrame:
    """Events of all sessions in a stream of valid frames (see the module text).

    Frames later than the watermark are dropped, as they are behind the consume
    cursor; ``numRowsDroppedByWatermark`` of the query progress counts them.
    """
    if not watermarked:
        frames = frames.withWatermark("timestamp", f"{delay_s} seconds")
    compact = compact_frames(frames, level, keep=("timestamp",))
    return fold_stream(classify(compact, catalog, keep_rejects=True, limits=True), **options)


def judged_texts(judged: DataFrame) -> DataFrame:
    """Judged frames as the state machine takes them: few columns, the frame as JSON, null fields left out."""
    rejected = F.col("reject_reason").isNotNull()
    text = F.when(rejected, F.to_json(F.struct(*_REJECT_COLUMNS))).otherwise(F.to_json(F.struct(*_FRAME_COLUMNS)))
    return judged.select("session_uuid", "timestamp", "ts_ms", rejected.alias("rejected"), text.alias("frame"))


def fold_stream(judged: DataFrame, **options: float) -> DataFrame:
    """Events of a stream of judged frames, rejects among them, with a watermark on ``timestamp``."""
    observed = judged_texts(judged).observe(
        "frames",
        F.count(F.lit(1)).alias("frames_processed"),
        F.count_if("rejected").alias("frames_rejected"),
        F.approx_count_distinct("session_uuid").alias("active_sessions"),
    )
    events = observed.groupBy("session_uuid").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(**options),
        outputStructType="event string",
        outputMode="Append",
        timeMode="EventTime",
    )
    return events.select(F.from_json("event", EVENT_SCHEMA).alias("event")).select("event.*")


def report_rows(events: DataFrame) -> DataFrame:
    """Final reports as the batch engine gives them (``report.session_reports``), windows and state included."""
    return events_of(events, "report").select(
        "session_uuid",
        "session_instance",
        "status",
        "exercise",
        F.timestamp_micros("ts_us").alias("timestamp"),
        "state",
        F.struct("windows", "feedback_summary", "total_windows", "exercise_duration").alias("feedback"),
    )


def events_of(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("kind") == kind)
