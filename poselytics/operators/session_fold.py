"""The session state machine: repetitions, error flags, inactivity and window starts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.operators.classify import classify
from poselytics.operators.ordered_scan import Chunked, ordered_scan
from poselytics.operators.reset_map import ResetMap, reset_map
from poselytics.sources.catalog import Catalog

WINDOW_S = 2.5

KEYS = ["session_uuid", "session_instance", "state_epoch"]


@dataclass(slots=True)
class SessionState:
    """State of one session instance; times in microseconds."""

    curr_state: str | None = "s1"
    prev_state: str | None = None
    state_seq: tuple[str, ...] = ()
    correct: int = 0  # since the last counter reset
    incorrect: int = 0
    inactive_us: int = 0
    inactive_front_us: int = 0
    incorrect_posture: bool = False
    critical_error: bool = False
    last_us: int | None = None
    window_us: int | None = None  # start of the active feedback window
    resets: int = 0
    frames: int = 0

    def step(
        self,
        ts: int,
        bad_posture: bool,
        new_state: str | None,
        critical: bool,
        success: tuple[str, ...],
        inactive_limit: int,
        window: int,
    ) -> tuple[str | None, bool, int | None]:
        """Fold one frame. Batch and streaming share this.

        Returns the repetition the frame completed (``correct`` or ``incorrect``),
        whether inactivity set the counters back after it, and the start of the
        feedback window it closed.
        """
        elapsed = 0 if self.last_us is None else ts - self.last_us
        self.last_us = ts
        self.frames += 1
        if bad_posture:
            self.incorrect_posture = True
            self.inactive_front_us += elapsed
            if self.inactive_front_us < inactive_limit:
                return _NOTHING
            self.inactive_front_us = 0
            self._reset_counters()
            return None, True, None

        seq = self.state_seq
        if new_state in success and (not seq or seq[-1] != new_state):
            seq = self.state_seq = (*seq, new_state)[-len(success) :]
        rep = None
        # only the length of the sequence and the state it returns to decide
        if len(seq) == len(success) and new_state == success[0]:
            if self.incorrect_posture or self.critical_error:
                rep = "incorrect"
                self.incorrect += 1
            else:
                rep = "correct"
                self.correct += 1
            self.state_seq = ()
            self.incorrect_posture = self.critical_error = False

        reset = False
        if self.curr_state == new_state:
            self.inactive_us += elapsed
            if self.inactive_us >= inactive_limit:
                reset = True
                self.inactive_us = 0
                self._reset_counters()
        else:
            self.inactive_us = 0
        self.prev_state, self.curr_state = self.curr_state, new_state
        if critical:
            self.critical_error = True

        closed = None
        if self.window_us is None:
            self.window_us = ts
        elif ts - self.window_us >= window:
            closed, self.window_us = self.window_us, ts
        return rep, reset, closed

    def _reset_counters(self) -> None:
        self.correct = self.incorrect = 0
        self.resets += 1


_NOTHING = (None, False, None)


class _RepWalk(NamedTuple):
    """Exit of the sequence automaton for one entry ``(length, last symbol)``."""

    appended: tuple[str, ...]  # symbols since the last repetition, or since entry
    has_rep: bool
    posture: bool  # flags raised since then
    error: bool


class _Transfer(NamedTuple):
    frames: int
    success: tuple[str, ...]
    limit: int
    first_us: int
    last_us: int
    first_is_bad: bool
    good_states: tuple[str | None, ...]  # the last two of the chunk
    first_good: tuple[int, str | None] | None
    last_good_us: int | None
    front: ResetMap
    idle_run: ResetMap  # leading run of one state
    idle_tail: tuple[int, int] | None  # (timer, resets) from the first change of state on
    windows: ResetMap
    reps: dict[tuple[int, str | None], _RepWalk]


_STATE = pa.struct(
    {
        "curr_state": pa.string(),
        "prev_state": pa.string(),
        "state_seq": pa.string(),
        "inactive_us": pa.int64(),
        "inactive_front_us": pa.int64(),
        "incorrect_posture": pa.bool_(),
        "critical_error": pa.bool_(),
    }
)


class SessionFoldMachine:
    """:meth:`SessionState.step` over a session's classified frames, as an ordered scan.

    ``state_after`` is filled where a session's rows end (in an Arrow batch), so
    on the last frame of every session, and NULL elsewhere.
    """

    inputs = ["ts_us", "bad_posture", "state", "critical", "session_exercise", "session_level"]
    outputs = [
        ("frame_no", pa.int64()),
        ("rep", pa.string()),
        ("reset_no", pa.int32()),
        ("is_reset", pa.bool_()),
        ("window_us", pa.int64()),
        ("closed_window_us", pa.int64()),
        ("state_after", _STATE),
    ]

    def __init__(self, rules: dict[tuple[str, int], tuple[tuple[str, ...], int]], window_s: float = WINDOW_S):
        self.rules = rules
        self.window = round(window_s * 1_000_000)

    def run(self, state, rows, lo, hi, out):
        times, bad, states, critical = (rows[c][lo:hi] for c in self.inputs[:4])
        success, limit = self.rules[rows["session_exercise"][lo], rows["session_level"][lo]]
        window = self.window
        state = SessionState() if state is None else replace(state)
        step = state.step
        if out is None:
            for ts, b, s, c in zip(times, bad, states, critical):
                step(ts, b, s, c, success, limit, window)
            return state
        frames, reps, numbers, resets, windows, closing, after = (
            out[name].append for name, _ in self.outputs
        )
        for ts, b, s, c in zip(times, bad, states, critical):
            numbers(state.resets)
            rep, reset, closed = step(ts, b, s, c, success, limit, window)
            frames(state.frames)
            reps(rep)
            resets(reset)
            windows(None if b else state.window_us)
            closing(closed)
        out["state_after"].extend([None] * (hi - lo - 1))
        after(
            {
                "curr_state": state.curr_state,
                "prev_state": state.prev_state,
                "state_seq": ",".join(state.state_seq),
                "inactive_us": state.inactive_us,
                "inactive_front_us": state.inactive_front_us,
                "incorrect_posture": state.incorrect_posture,
                "critical_error": state.critical_error,
            }
        )
        return state

    def transfer(self, rows) -> _Transfer:
        success, limit = self.rules[rows["session_exercise"][0], rows["session_level"][0]]
        times = np.asarray(rows["ts_us"], dtype=np.int64)
        is_bad = np.asarray(rows["bad_posture"], dtype=bool)
        elapsed = np.diff(times, prepend=times[:1])
        good = np.flatnonzero(~is_bad)
        states = [rows["state"][i] for i in good.tolist()]
        idle = elapsed[good]
        run = next((k for k, s in enumerate(states) if s != states[0]), len(states))
        tail = None
        if run < len(states):
            timer = resets = 0
            for k in range(run + 1, len(states)):
                same = states[k] == states[k - 1]
                timer = timer + int(idle[k]) if same else 0
                if same and timer >= limit:
                    timer, resets = 0, resets + 1
            tail = (timer, resets)
        return _Transfer(
            len(times),
            success,
            limit,
            int(times[0]),
            int(times[-1]),
            bool(is_bad[0]),
            tuple(states[-2:]),
            (int(times[good[0]]), states[0]) if states else None,
            int(times[good[-1]]) if states else None,
            reset_map(elapsed[is_bad], limit),
            reset_map(idle[:run], limit),
            tail,
            reset_map(np.diff(times[good], prepend=times[good][:1]), self.window),
            _rep_walks(success, states, good, np.flatnonzero(is_bad), rows["critical"]),
        )

    def apply(self, transfer: _Transfer, state: SessionState | None) -> SessionState | None:
        t = transfer
        s = SessionState() if state is None else state
        elapsed = 0 if s.last_us is None else t.first_us - s.last_us
        resets = s.resets
        front = t.front.exit(s.inactive_front_us + (elapsed if t.first_is_bad else 0), t.limit)
        if front is None:
            return None
        resets += front[1]
        curr, prev, idle, window = s.curr_state, s.prev_state, s.inactive_us, s.window_us
        if t.first_good is not None:
            first_us, first_state = t.first_good
            if first_state == s.curr_state:
                timer = t.idle_run.exit(idle + (0 if t.first_is_bad else elapsed), t.limit)
            else:
                timer = t.idle_run.fresh
            opened = (
                t.windows.fresh if window is None else t.windows.exit(first_us - window, self.window)
            )
            if timer is None or opened is None:
                return None
            idle, more = timer if t.idle_tail is None else (t.idle_tail[0], timer[1] + t.idle_tail[1])
            resets += more
            window = t.last_good_us - opened[0]
            prev, curr = (curr, *t.good_states)[-2:]
        seq = s.state_seq
        walk = t.reps[len(seq), seq[-1] if seq else None]
        if not walk.has_rep:
            appended, posture, error = (*seq, *walk.appended), s.incorrect_posture, s.critical_error
        else:
            appended, posture, error = walk.appended, False, False
        return SessionState(
            curr,
            prev,
            appended[-len(t.success) :],
            0,  # counts are summed from the replayed frames, never chained
            0,
            idle,
            front[0],
            posture or walk.posture,
            error or walk.error,
            t.last_us,
            window,
            resets,
            s.frames + t.frames,
        )


def _rep_walks(success, states, good, bad, critical) -> dict[tuple[int, str | None], _RepWalk]:
    """Walk the sequence automaton from every entry it can be in.

    What it does next depends on the length and the last symbol alone, so there
    are only ``len(success) * len(set(success)) + 1`` entries.
    """
    limit, home = len(success), success[0]
    members = [(s, int(i)) for s, i in zip(states, good) if s in success]
    runs = []
    for symbol, group in groupby(members, key=lambda m: m[0]):
        positions = [i for _, i in group]
        runs.append((symbol, positions[0], positions[-1]))
    last_bad = int(bad[-1]) if len(bad) else -1
    marked = np.flatnonzero(critical)
    last_critical = int(marked[-1]) if len(marked) else -1
    entries = [(0, None), *((n, s) for n in range(1, limit + 1) for s in dict.fromkeys(success))]
    walks = {}
    for length, last in entries:
        entry = (length, last)
        appended: list[str] = []
        rep_at = None
        for symbol, first, final in runs:
            if length == 0 or symbol != last:
                appended = [*appended, symbol][-limit:]
                length, last = min(length + 1, limit), symbol
            if symbol == home and length == limit:
                rep_at, length, appended = first, 0, []
                if final != first:
                    if limit == 1:
                        rep_at = final  # every frame of the run is a repetition
                    else:
                        length, last, appended = 1, symbol, [symbol]
        since = -1 if rep_at is None else rep_at
        walks[entry] = _RepWalk(
            tuple(appended), rep_at is not None, last_bad > since, last_critical >= max(since, 0)
        )
    return walks


def fold_rules(catalog: Catalog) -> dict[tuple[str, int], tuple[tuple[str, ...], int]]:
    """Sequence and limit by exercise and level; a fold by them needs one version of each."""
    if catalog.versioned:
        raise ValueError("a catalog with versions judges frames; choose one version to fold sessions by")
    return {(r.exercise, r.level): (r.success_sequence, r.inactive_us) for r in catalog.rules}


def session_trace(tracked: Chunked, catalog: Catalog, window_s: float = WINDOW_S) -> DataFrame:
    """Classify every frame by its session's exercise and fold it.

    Classification is narrow (broadcast join), so the chunks and their order
    survive it and nothing is shuffled again.
    """

    def judged(frames: DataFrame) -> DataFrame:
        leveled = frames.withColumn("level", F.col("session_level"))
        return classify(leveled, catalog, exercise="session_exercise").drop("angles")

    machine = SessionFoldMachine(fold_rules(catalog), window_s)
    return ordered_scan(tracked.then(judged), KEYS, machine).df


def trace_rejects(tracked: Chunked, catalog: Catalog) -> DataFrame:
    """Frames that the trace leaves out, with ``reject_reason``; judged by the exercise the fold goes by."""
    leveled = tracked.df.withColumn("level", F.col("session_level"))
    judged = classify(leveled, catalog, exercise="session_exercise", keep_rejects=True)
    return judged.filter(F.col("reject_reason").isNotNull()).select(
        "session_uuid", "session_instance", "frame_track_uuid", "session_exercise", "reject_reason"
    )


def rep_events(trace: DataFrame) -> DataFrame:
    """Every completed repetition, whether or not a later reset discarded it."""
    return trace.filter(F.col("rep").isNotNull()).select(
        "session_uuid", "session_instance", "ts_us", "frame_track_uuid", "rep"
    )


def reset_events(trace: DataFrame) -> DataFrame:
    """Frames at which inactivity set the counters back, and which timer did it."""
    return trace.filter("is_reset").select(
        "session_uuid",
        "session_instance",
        "ts_us",
        "frame_track_uuid",
        F.when(F.col("bad_posture"), F.lit("posture")).otherwise(F.lit("inactivity")).alias("reason"),
    )


def session_states(trace: DataFrame) -> DataFrame:
    """Final state per session instance.

    Repetitions count from the last reset of the last state epoch on, so they are
    first summed per (epoch, reset) and the latest sum is taken. Only frames that
    complete a repetition, reset the counters or end a batch take part, and both
    steps aggregate partially before they shuffle.
    """
    ended = F.col("state_after").isNotNull()
    latest = F.struct("state_epoch", (F.col("reset_no") + F.col("is_reset").cast("int")).alias("reset_no"))
    end = F.struct(
        "state_epoch",
        "frame_no",
        F.col("ts_us").alias("last_us"),
        "state_after",
        F.col("exercise").alias("last_exercise"),
        F.col("completed_us").isNotNull().alias("is_completing"),
    )
    per_reset = (
        trace.filter(F.col("rep").isNotNull() | F.col("is_reset") | ended)
        .groupBy("session_uuid", "session_instance", "state_epoch", "reset_no")
        .agg(
            F.count_if(F.col("rep") == "correct").alias("correct"),
            F.count_if(F.col("rep") == "incorrect").alias("incorrect"),
            F.max(latest).alias("latest"),
            F.max(F.when(ended, end)).alias("end"),
        )
    )
    counts = F.struct("state_epoch", "reset_no", "correct", "incorrect")
    final = per_reset.groupBy("session_uuid", "session_instance").agg(
        F.max("latest").alias("latest"), F.max(counts).alias("counts"), F.max("end").alias("end")
    )
    # a reset that no frame follows leaves counts of zero behind
    live = (F.col("counts.state_epoch") == F.col("latest.state_epoch")) & (
        F.col("counts.reset_no") == F.col("latest.reset_no")
    )
    return final.select(
        "session_uuid",
        "session_instance",
        F.col("latest.state_epoch").alias("state_epoch"),
        F.when(live, F.col("counts.correct")).otherwise(F.lit(0)).alias("correct"),
        F.when(live, F.col("counts.incorrect")).otherwise(F.lit(0)).alias("incorrect"),
        "end.state_after.*",
        "end.last_exercise",
        "end.last_us",
        "end.is_completing",
    )
