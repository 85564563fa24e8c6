"""Session analysis on hand traces, and the same results for any chunking."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from poselytics.operators import session_fold
from poselytics.operators.classify import compact_frames
from poselytics.operators.feedback import feedback_summary, feedback_windows
from poselytics.operators.lifecycle import order_frames, session_lifecycle, with_lifecycle
from poselytics.operators.session_fold import SessionFoldMachine, session_states, session_trace
from poselytics.plans.analysis import SessionAnalysis
from poselytics.sources.catalog import BUILTIN_FOLDER, builtin_catalog, catalog_from_documents
from poselytics.sources.events import events_frames
from poselytics.sources.sinks import report_messages
from tests.conftest import SMALL

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

FRAME = (
    "session_uuid string, frame_track_uuid string, timestamp timestamp, exercise string, "
    "video_duration double, current_time double, metrics struct<angles:array<struct<name:string,value:double>>>"
)


def frames_of(spark, session_frames):
    """``(session, second, elbow, shoulder, offset, current_time)`` tuples as frames."""
    data = [
        (
            session,
            f"{i:05d}",
            START + dt.timedelta(seconds=second),
            "dumbbell-arm",
            100.0,
            current,
            ([("elbow_angle", elbow), ("shoulder_angle", shoulder), ("offset_angle", offset)],),
        )
        for i, (session, second, elbow, shoulder, offset, current) in enumerate(session_frames)
    ]
    return spark.createDataFrame(data, FRAME)


def trace_of(spark, frames, n_chunks=None, catalog=None, **options):
    ordered = order_frames(compact_frames(frames), n_chunks)
    return session_trace(with_lifecycle(ordered, **options), catalog or builtin_catalog(spark))


ELBOW = {"s1": 120.0, "s2": 90.0, "s3": 55.0}


@pytest.mark.parametrize(
    "states, reps, left",
    [
        ("s1 s2 s3 s2 s1", 1, ""),
        ("s1 s2 s1 s2 s1", 1, ""),
        ("s1 s2 s3 s1", 1, ""),
        ("s2 s3 s1", 0, "s2,s3,s1"),
        ("s1 s1 s2 s2 s3 s3 s1 s1", 1, "s1"),
        ("s1 s2 s3 s2 s1 s2 s3 s2 s1", 2, ""),
    ],
)
def test_repetitions(spark, states, reps, left):
    frames = frames_of(
        spark, [("a", i * 0.1, ELBOW[s], 20.0, 0.0, 0.0) for i, s in enumerate(states.split())]
    )
    row = session_states(trace_of(spark, frames)).first()
    assert (row.correct, row.incorrect, row.state_seq) == (reps, 0, left)


def test_errors_make_repetitions_incorrect(spark):
    good = [("s1", 0), ("s2", 0), ("s3", 0), ("s2", 0), ("s1", 0)]
    leaning = [("s1", 0), ("s2", 90), ("s3", 0), ("s2", 0), ("s1", 0)]
    frames = []
    for name, moves, shoulder in (("good", good, 20), ("leaning", leaning, 20), ("critical", good, 50)):
        frames += [
            (name, i * 0.1, ELBOW[s], float(shoulder), float(offset), 0.0)
            for i, (s, offset) in enumerate(moves)
        ]
    found = {
        r.session_uuid: (r.correct, r.incorrect) for r in session_states(trace_of(spark, frames_of(spark, frames))).collect()
    }
    # leaning frames are not folded, so s2 is seen once less and the sequence still fills up
    assert found == {"good": (1, 0), "leaning": (0, 1), "critical": (0, 1)}


def test_windows_and_summary(spark):
    # lower_wrist (a) below 50, keep_hand_near (b) outside 12..35
    a, b = (45.0, 20.0), (55.0, 38.0)
    both = (45.0, 38.0)
    moments = [(0.0, a), (1.0, both), (2.0, a), (2.5, b), (3.0, a)]
    frames = frames_of(spark, [("w", s, elbow, shoulder, 0.0, 0.0) for s, (elbow, shoulder) in moments])
    trace = trace_of(spark, frames)
    windows = feedback_windows(trace).collect()
    assert len(windows) == 1
    assert windows[0].end_us - windows[0].start_us == 2_500_000
    assert [(f.id, f["count"], f.frame_ratio) for f in windows[0].feedback] == [("lower_wrist", 3, 0.75)]
    summary = feedback_summary(feedback_windows(trace)).first()
    assert (summary.feedback_id, summary.windows_count, summary.total_occurrences, summary.window_ratio) == (
        "lower_wrist",
        1,
        3,
        1.0,
    )
    assert feedback_windows(trace, flush_open=True).count() == 2


def test_inactivity_clears_the_counters(spark):
    moves = [(i * 0.1, s) for i, s in enumerate(["s1", "s2", "s3", "s2", "s1"])]
    still = [(0.4 + i, "s1") for i in range(1, 27)]
    frames = frames_of(spark, [("i", t, ELBOW[s], 20.0, 0.0, 0.0) for t, s in moves + still])
    row = session_states(trace_of(spark, frames)).first()
    assert (row.correct, row.incorrect, row.inactive_us) == (0, 0, 1_000_000)
    # a limit no gap reaches keeps the repetition
    patient = builtin_catalog(spark).with_inactive_limit(60)
    row = session_states(trace_of(spark, frames, catalog=patient)).first()
    assert (row.correct, row.inactive_us) == (1, 26_000_000)


def test_posture_clears_the_counters(spark):
    moves = [("p", i * 0.1, ELBOW[s], 20.0, 0.0, 0.0) for i, s in enumerate(["s1", "s2", "s3", "s2", "s1"])]
    leaning = [("p", 0.4 + i, 120.0, 20.0, -90.0, 0.0) for i in range(1, 26)]
    row = session_states(trace_of(spark, frames_of(spark, moves + leaning))).first()
    assert (row.correct, row.inactive_front_us, row.incorrect_posture) == (0, 0, True)


def test_lifecycle_reopens_sessions(spark):
    frames = [("done", t, 120.0, 20.0, 0.0, c) for t, c in [(0, 0.0), (5, 99.9), (15, 0.0), (15.5, 0.0)]]
    frames += [("idle", t, 120.0, 20.0, 0.0, None) for t in (0, 300, 600.5)]
    tracked = with_lifecycle(order_frames(compact_frames(frames_of(spark, frames)))).df
    found = {
        (r.session_uuid, r.session_instance): (r.n_frames, r.status) for r in session_lifecycle(tracked).collect()
    }
    assert found == {
        ("done", 0): (3, "completed"),  # ten seconds after completing still belong to it
        ("done", 1): (1, "timeout"),
        ("idle", 0): (2, "timeout"),  # exactly five minutes is no timeout
        ("idle", 1): (1, "timeout"),
    }


def test_reports_as_messages(spark):
    frames = frames_of(spark, [("r", t, 120.0, 20.0, 0.0, c) for t, c in [(0, 0.0), (5, 99.95)]])
    analysis = SessionAnalysis(frames.unionByName(frames), builtin_catalog(spark))
    assert analysis.lifecycle.first().n_frames == 2
    assert (analysis.reps.count(), analysis.resets.count(), analysis.feedback.count()) == (0, 0, 0)
    message = report_messages(analysis.reports()).first()
    assert message.key == "r"
    assert '"status":"completed"' in message.value
    assert '"timestamp":"2024-01-01T00:00:05.000000Z"' in message.value
    assert '"state_seq":["s1"]' in message.value


def _results(trace):
    states = sorted(tuple(map(str, r)) for r in session_states(trace).collect())
    windows = sorted(tuple(map(str, r)) for r in feedback_windows(trace).collect())
    return states, windows


@pytest.fixture(scope="module")
def hot_frames(spark):
    """One session holds nine of ten frames; inactivity, gaps and completions all occur."""
    hot = F.when(F.substring("frame_track_uuid", -1, 1) != "7", F.lit("hot"))
    frames = events_frames(spark, SMALL)
    return frames.withColumn("session_uuid", F.coalesce(hot, F.col("session_uuid")))


@pytest.fixture(scope="module")
def one_chunk(spark, hot_frames):
    catalog = builtin_catalog(spark).with_inactive_limit(0.3)
    return _results(trace_of(spark, hot_frames, 1, catalog, timeout_s=1.0, state_ttl_s=0.4))


@pytest.mark.parametrize("n_chunks", [2, 7, 40])
def test_a_hot_session_is_spread_over_chunks(spark, hot_frames, one_chunk, n_chunks):
    catalog = builtin_catalog(spark).with_inactive_limit(0.3)
    ordered = order_frames(compact_frames(hot_frames), n_chunks)
    assert ordered.n_chunks == n_chunks
    assert len([c for c, key in ordered.spread if key == "hot"]) >= 0.8 * n_chunks
    trace = session_trace(with_lifecycle(ordered, timeout_s=1.0, state_ttl_s=0.4), catalog)
    assert _results(trace) == one_chunk


def test_chunks_too_coarse_to_chain_are_replayed(spark, hot_frames, one_chunk, monkeypatch):
    class Coarse(SessionFoldMachine):
        """Describes windows too coarsely, so every spread chunk has to be replayed."""

        def transfer(self, rows):
            described = super().transfer(rows)
            opaque = described.windows._replace(sums=described.windows.sums[:0], peak=2**62)
            return described._replace(windows=opaque)

    monkeypatch.setattr(session_fold, "SessionFoldMachine", Coarse)
    catalog = builtin_catalog(spark).with_inactive_limit(0.3)
    trace = trace_of(spark, hot_frames, 5, catalog, timeout_s=1.0, state_ttl_s=0.4)
    assert _results(trace) == one_chunk


def test_mixed_exercises_follow_the_first_frame(spark):
    document = json.loads((BUILTIN_FOLDER / "dumbbell-arm.json").read_text())
    other = json.loads(json.dumps(document))
    other["state_machine"]["beginner"]["states"] = [{"id": "s1", "condition": "elbow_angle > 0"}]
    catalog = catalog_from_documents(
        spark, {"dumbbell-arm": json.dumps(document), "other": json.dumps(other)}
    )
    frames = frames_of(spark, [("m", t, 90.0, 20.0, 0.0, 0.0) for t in range(3)])
    mixed = frames.withColumn(
        "exercise", F.when(F.col("frame_track_uuid") != "00000", F.lit("other")).otherwise(F.col("exercise"))
    )
    trace = trace_of(spark, mixed, catalog=catalog)
    assert {r.state for r in trace.select("state").collect()} == {"s2"}
