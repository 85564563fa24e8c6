"""The registered queries: each reads the given tables in full."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poselytics.functions.text import fixed_text, parse_analysis, score_prompts, with_texts
from poselytics.operators import buffer, feedback
from poselytics.operators.classify import (
    classify,
    compact_frames,
    frame_angles,
    frame_violations,
    rule_rejects,
    session_exercise,
    with_messages,
)
from poselytics.operators.lifecycle import (
    PROCESSING_DELAY_S,
    idle_gaps,
    order_frames,
    session_lifecycle,
    with_lifecycle,
)
from poselytics.operators.report import session_reports
from poselytics.operators.session_fold import (
    rep_events,
    reset_events,
    session_states,
    session_trace,
)
from poselytics.plans.analysis import SessionAnalysis
from poselytics.schema import FRAME
from poselytics.session import configure, shared_folder
from poselytics.sources.catalog import (
    BUILTIN_FOLDER,
    builtin_catalog,
    catalog_from_documents,
    read_catalog,
    version_table,
    write_documents,
)
from poselytics.sources.events import EPOCH_US, events_frames, frames_of
from poselytics.sources.frames import (
    parse_frames,
    rejected_frames,
    unknown_exercise,
    valid_frames,
)
from poselytics.sources.sinks import report_messages
from poselytics.streaming.jobs import RunMetrics, judge_stream, judged_frames, write_stream
from poselytics.streaming.sessions import EVENT_SCHEMA, events_of, fold_stream, report_rows, session_events

EPOCH_MS = EPOCH_US // 1000
AS_OF_MS = EPOCH_MS + 50_000

# session time is compressed, so the queries about silence use short limits
SHORT_TIMEOUT_S = 5.0
SHORT_INACTIVE_S = 1.5

END_SESSION = "end-of-stream"
# event time, from the first frame on, at which the rules of a stream change
RULES_CHANGE_S = 30

Query = Callable[[SparkSession, str], DataFrame]


def _compact(spark: SparkSession, sf_dir: str, exercise: str | None = "dumbbell-arm") -> DataFrame:
    return compact_frames(events_frames(configure(spark), sf_dir, exercise), F.col("level"))


def _classified(spark: SparkSession, sf_dir: str, **options: bool) -> DataFrame:
    return classify(_compact(spark, sf_dir), builtin_catalog(spark), **options)


def _tracked(spark: SparkSession, sf_dir: str, **options: float | None):
    return with_lifecycle(order_frames(_compact(spark, sf_dir)), **options)


def _trace(spark: SparkSession, sf_dir: str, inactive_s: float | None = None, **options: float | None) -> DataFrame:
    tracked = _tracked(spark, sf_dir, **options)
    catalog = builtin_catalog(spark)
    if inactive_s is not None:
        catalog = catalog.with_inactive_limit(inactive_s)
    return session_trace(tracked, catalog)


def _analysis(spark: SparkSession, sf_dir: str, **options: float | bool) -> SessionAnalysis:
    frames = events_frames(configure(spark), sf_dir)
    options = {"dedup": False, **options}
    return SessionAnalysis(frames, builtin_catalog(spark), F.col("level"), **options)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame messages as JSON text; one in two is broken in one of several ways."""
    events = configure(spark).read.parquet(f"{sf_dir}/events.parquet")
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.get_json_object("props", "$.k")
    point = '{"x":1,"y":2}'

    def angle(value: Column) -> list[Column]:
        return [
            F.lit('{"name":"elbow_angle","value":'),
            value,
            F.lit(f',"point1":{point},"point2":{point},"ref_point":{point}}}'),
        ]

    kind = F.col("event_id") % 20
    session = F.when(kind == 1, F.lit("")).otherwise(
        F.concat(F.lit('"session_uuid":"sess-'), F.col("user_id"), F.lit('",'))
    )
    exercise = F.when(kind == 2, F.lit("null")).otherwise(F.lit('"dumbbell-arm"'))
    time = F.when(kind == 3, F.lit("yesterday")).otherwise(ts)
    current = (
        F.when(kind == 4, F.lit(""))
        .when(kind == 5, F.lit(',"current_time":null'))
        .when(kind == 6, F.lit(',"current_time":"soon"'))
        .otherwise(F.concat(F.lit(',"current_time":'), k))
    )
    marks = F.when(kind == 7, F.lit('[{"x":1}]')).when(kind == 8, F.lit("null")).otherwise(F.lit(f"[{point}]"))
    value = F.when(kind == 9, F.lit("null")).otherwise(k)
    side = F.when(kind == 10, F.lit('{"side":"left"}')).otherwise(F.lit('{"side":"left","probability":null}'))
    text = F.concat(
        F.lit('{"frame_track_uuid":"f-'),
        F.col("event_id"),
        F.lit('","timestamp":"'),
        time,
        F.lit('","exercise":'),
        exercise,
        F.lit(","),
        session,
        F.lit('"video_duration":60,"landmarks":'),
        marks,
        F.lit(',"metrics":{"angles":['),
        *angle(value),
        F.lit('],"dominant_side":'),
        side,
        F.lit("}"),
        current,
        F.when(kind == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return events.select(text.alias("value"))


def frame_parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_frames(parse_frames(_messages(spark, sf_dir)))


def frames_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_frames(parse_frames(_messages(spark, sf_dir))).select(
        "frame_track_uuid",
        F.unix_micros("timestamp").alias("ts_us"),
        "session_uuid",
        "video_duration",
        "current_time",
        F.col("metrics.angles")[0]["value"].alias("elbow_angle"),
        F.size("landmarks").alias("n_landmarks"),
    )


def frames_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = events_frames(configure(spark), sf_dir)
    kept = ["session_uuid", "frame_track_uuid", "timestamp", "current_time"]
    return buffer.dedup_frames(frames.unionByName(frames), kept).select(
        "session_uuid", "frame_track_uuid", F.unix_micros("timestamp").alias("ts_us"), "current_time"
    )


def buffer_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("frame_track_uuid", 3, 20).cast("bigint")
    arrivals = _compact(spark, sf_dir).select(
        "session_uuid",
        "frame_track_uuid",
        "ts_ms",
        ((number % 7) * F.lit(10**12) + number).alias("arrival_seq"),
    )
    return buffer.retention(arrivals)


def frames_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.timestamp_millis(F.lit(EPOCH_MS + s * 1000)) for s in (10, 20))
    found = buffer.frames_between(events_frames(configure(spark), sf_dir), start, end)
    return found.select(
        "session_uuid", "frame_track_uuid", F.unix_millis("timestamp").alias("ts_ms")
    )


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return users.filter(F.col("user_id") % 3 != 0).select(
        F.concat(F.lit("sess-"), F.col("user_id")).alias("session_uuid"),
        (F.lit(EPOCH_MS + 20_000) + (F.col("user_id") % 5) * 1000).alias("last_ms"),
    )


def _buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compact(spark, sf_dir).select("session_uuid", "frame_track_uuid", "ts_ms")


def incremental_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffer.consume(_buffered(spark, sf_dir), _cursors(spark, sf_dir), AS_OF_MS)


def buffer_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffer.remaining(_buffered(spark, sf_dir), _cursors(spark, sf_dir), AS_OF_MS)


def consume_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = _cursors(spark, sf_dir)
    consumed = buffer.consume(_buffered(spark, sf_dir), cursors, AS_OF_MS)
    return buffer.advance_cursors(consumed, cursors, AS_OF_MS)


def late_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffer.late_frames(_buffered(spark, sf_dir), _cursors(spark, sf_dir)).drop("last_ms")


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffer.active_sessions(events_frames(configure(spark), sf_dir))


def latest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact = _compact(spark, sf_dir).select(
        "session_uuid", "ts_ms", "frame_track_uuid", "ts_us", F.col("angles")["elbow_angle"].alias("elbow_angle")
    )
    return buffer.latest_frames(compact).select("frame.*")


def clean_old_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffer.clean_old_frames(_buffered(spark, sf_dir), AS_OF_MS, 30)


def idle_gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idle_gaps(_tracked(spark, sf_dir).df, 2.0)


def frame_angle_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = events_frames(configure(spark), sf_dir)
    elbow = F.col("metrics.angles")[0]
    doubled = elbow.withField("value", elbow["value"] * 2)
    repeated = F.col("metrics").withField("angles", F.concat("metrics.angles", F.array(doubled)))
    return frame_angles(compact_frames(frames.withColumn("metrics", repeated)))


def posture_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("session_uuid", "frame_track_uuid", "bad_posture")


def frame_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _compact(spark, sf_dir).withColumn("level", F.explode(F.array(F.lit(0), F.lit(1))))
    return classify(both, builtin_catalog(spark)).select(
        "session_uuid", "frame_track_uuid", "level", "state"
    )


def session_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_exercise(_compact(spark, sf_dir, None))


def unknown_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = events_frames(configure(spark), sf_dir, None)
    known = F.when(F.col("exercise") == "click", F.lit("dumbbell-arm")).otherwise(F.col("exercise"))
    return unknown_exercise(frames.withColumn("exercise", known), builtin_catalog(spark)).select(
        "session_uuid", "frame_track_uuid", "exercise"
    )


def frame_rule_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _faulty_frames(events_frames(configure(spark), sf_dir, None))
    return rule_rejects(compact_frames(frames, F.col("level")), builtin_catalog(spark))


def _stored_documents() -> dict[str, str]:
    """Documents by event type: a sound one and four with a fault each."""
    text = (BUILTIN_FOLDER / "dumbbell-arm.json").read_text(encoding="utf-8")
    faulty = {kind: json.loads(text) for kind in ("error", "purchase", "signup")}
    faulty["error"]["state_machine"]["beginner"]["states"][1]["condition"] = "elbow_angle.value > 1"
    del faulty["purchase"]["thresholds"]["pro"]["INACTIVE_THRESH"]
    del faulty["signup"]["thresholds"]["beginner"]["angle_thresh"]["elbow_angle"][0]["feedback"]
    return {"click": text, "view": text[:-30], **{kind: json.dumps(d) for kind, d in faulty.items()}}


def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each exercise beside what a stored catalog holds for it: its rules, or why it has none."""
    folder = f"{_new_folder(configure(spark))}/catalog"
    write_documents(spark, folder, _stored_documents())
    catalog = read_catalog(spark, folder)
    frames = events_frames(spark, sf_dir, None).groupBy("exercise").agg(F.count("*").alias("n_frames"))
    sound = catalog.rule_table().groupBy("exercise").agg(
        F.sum(F.size("states")).alias("n_states"), F.sum(F.size("rules")).alias("n_rules")
    )
    reasons = spark.createDataFrame(list(catalog.invalid.items()), "exercise string, reason string")
    return frames.join(sound, "exercise", "left").join(reasons, "exercise", "left")


def frame_violation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_violations(_classified(spark, sf_dir, stop_at_critical=False)).drop("exercise")


def _variant(k: int) -> str:
    """Catalog document of exercise number ``k``; one in four has 20 critical rules."""

    def level(low: int) -> tuple[dict, dict]:
        high, many = 100 + k % 13, k % 4 == 0
        states = [
            {"id": "s1", "condition": f"elbow_angle > {high}"},
            {"id": "s2", "condition": f"{low} < elbow_angle <= {high} and not elbow_angle % 10 < {k % 3}"},
            {"id": "s3", "condition": f"elbow_angle <= {low} or (elbow_angle + shoulder_angle) / 2 > 70"},
        ]
        rules = [
            {"max": 45 - 2 * j + k % 5, "feedback": f"rule-{j}", "critical": many or j == 2}
            for j in range(20 if many else 3)
        ]
        return (
            {"states": states, "success_sequence": ["s1", "s2", "s3", "s1"]},
            {"angle_thresh": {"shoulder_angle": rules}, "OFFSET_THRESH": 40.0 + k % 6, "INACTIVE_THRESH": 25.0},
        )

    beginner, pro = level(60 + k % 7), level(65 + k % 7)
    return json.dumps(
        {
            "exercise_name": f"exercise {k}",
            "dominant_side_points": ["wrist", "wrist"],
            "landmark_features_dict": {"left": ["wrist"], "right": ["wrist"], "nose": ["nose"]},
            "angles": [{"name": n} for n in ("elbow_angle", "shoulder_angle", "offset_angle")],
            "state_machine": {"beginner": beginner[0], "pro": pro[0]},
            "thresholds": {"beginner": beginner[1], "pro": pro[1]},
            "feedback_messages": [{"id": f"rule-{j}", "message": f"MIND RULE {j}", "severity": "warning"} for j in range(20)],
            "inactivity_time": 5,
        }
    )


def frame_feedback_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames judged by a catalog of 80 exercises: event type and 16 groups of users."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    catalog = catalog_from_documents(spark, {f"{kind}-{n}": _variant(16 * i + n) for i, kind in enumerate(kinds) for n in range(16)})
    compact = _compact(spark, sf_dir, None)
    group = F.substring("session_uuid", 6, 20).cast("bigint") % 16
    compact = compact.withColumn("exercise", F.concat_ws("-", "exercise", group))
    return classify(compact, catalog).select(
        "session_uuid",
        "frame_track_uuid",
        "exercise",
        "bad_posture",
        "state",
        F.array_join("feedback_ids", ",").alias("feedback_ids"),
        "critical",
    )


def frame_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = _classified(spark, sf_dir).withColumn("session_instance", F.lit(0))
    return feedback.frame_feedback(classified).select(
        "session_uuid",
        "frame_track_uuid",
        "ts_us",
        F.array_join("feedback_ids", ",").alias("feedback_ids"),
    )


def feedback_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = builtin_catalog(spark)
    return with_messages(frame_violations(_classified(spark, sf_dir)), catalog).select(
        "session_uuid", "frame_track_uuid", "seq", "feedback_id", "message", "severity"
    )


def rep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_states(_trace(spark, sf_dir)).select(
        "session_uuid", "session_instance", "correct", "incorrect"
    )


def rep_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep_events(_trace(spark, sf_dir))


def _resets(spark: SparkSession, sf_dir: str, reason: str) -> DataFrame:
    trace = _trace(spark, sf_dir, inactive_s=SHORT_INACTIVE_S)
    return reset_events(trace).filter(F.col("reason") == reason).drop("reason")


def inactivity_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resets(spark, sf_dir, "inactivity")


def posture_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resets(spark, sf_dir, "posture")


def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = _trace(spark, sf_dir, inactive_s=SHORT_INACTIVE_S, timeout_s=SHORT_TIMEOUT_S)
    return session_states(trace).drop("state_epoch", "last_exercise")


def session_state_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = _trace(spark, sf_dir, state_ttl_s=3.0)
    return session_states(trace).select(
        "session_uuid", "session_instance", "state_epoch", "correct", "incorrect", "state_seq"
    )


def _flat_windows(windows: DataFrame) -> DataFrame:
    return windows.select(
        "session_uuid", "session_instance", "start_us", "end_us", F.explode_outer("feedback").alias("f")
    ).select(
        "session_uuid",
        "session_instance",
        "start_us",
        "end_us",
        F.col("f.id").alias("feedback_id"),
        F.col("f.count").alias("count"),
        F.col("f.frame_ratio").alias("frame_ratio"),
    )


def feedback_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_windows(feedback.feedback_windows(_trace(spark, sf_dir)))


def feedback_windows_low_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = feedback.feedback_windows(_trace(spark, sf_dir), min_frame_ratio=0.2, flush_open=True)
    return windows.select(
        "session_uuid",
        "session_instance",
        "start_us",
        F.array_join(
            F.transform("feedback", lambda f: F.concat_ws(":", f["id"], f["count"].cast("string"))), ","
        ).alias("feedback"),
    )


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = feedback.feedback_windows(_trace(spark, sf_dir))
    return feedback.feedback_summary(windows).drop("first_seen", "state_epoch")


def issue_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = feedback.feedback_windows(_trace(spark, sf_dir))
    return feedback.issue_tiers(feedback.feedback_summary(windows)).drop("state_epoch")


def exercise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).summaries.select(
        "session_uuid",
        "session_instance",
        "total_windows",
        "exercise_duration",
        "correct",
        "incorrect",
        F.size(F.filter("windows", lambda w: F.size(w["feedback"]) > 0)).alias("windows_with_feedback"),
        F.array_join(F.transform("feedback_summary", lambda i: i["id"]), ",").alias("issues"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_lifecycle(_tracked(spark, sf_dir, timeout_s=SHORT_TIMEOUT_S).df)


def reopened_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercise of each session instance: that of the frame that opened it."""
    ordered = order_frames(_compact(spark, sf_dir, None))
    tracked = with_lifecycle(ordered, timeout_s=SHORT_TIMEOUT_S).df
    return tracked.select("session_uuid", "session_instance", "session_exercise").distinct()


def analysis_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event types have rules; instances opened by another are rejected."""
    frames = events_frames(configure(spark), sf_dir, None)
    known = F.when(F.col("exercise").isin("click", "view"), F.lit("dumbbell-arm")).otherwise(F.col("exercise"))
    renamed = frames.withColumn("exercise", known)
    return SessionAnalysis(
        renamed, builtin_catalog(spark), F.col("level"), dedup=False, timeout_s=SHORT_TIMEOUT_S
    ).rejects


def _flat_reports(reports: DataFrame) -> DataFrame:
    return reports.select(
        "session_uuid",
        "session_instance",
        "status",
        "exercise",
        F.unix_micros("timestamp").alias("last_us"),
        F.col("state.curls.correct").alias("correct"),
        F.col("state.curls.incorrect").alias("incorrect"),
        F.col("state.curr_state").alias("curr_state"),
        F.array_join("state.state_seq", "").alias("state_seq"),
        F.col("state.timers.inactive_time").alias("inactive_time"),
        F.col("state.flags.critical_error").alias("critical_error"),
        F.col("feedback.total_windows").alias("total_windows"),
        F.col("feedback.exercise_duration").alias("exercise_duration"),
    )


def session_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the full chain, identical frames collapsed first
    return _flat_reports(_analysis(spark, sf_dir, dedup=True).reports())


def running_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the sessions closed by the end of the data; the rest still run."""
    summaries = _analysis(spark, sf_dir, timeout_s=SHORT_TIMEOUT_S).summaries
    reports = session_reports(summaries, EPOCH_US + 72_000_000, 1.0)
    return reports.select("session_uuid", "session_instance", "status")


def report_message_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message_fields(report_messages(_analysis(spark, sf_dir).reports()))


def _message_fields(messages: DataFrame) -> DataFrame:
    def field(path: str) -> Column:
        return F.get_json_object("value", f"$.{path}")

    return messages.select(
        F.col("key").alias("session_uuid"),
        field("session_instance").cast("int").alias("session_instance"),
        field("status").alias("status"),
        field("timestamp").alias("timestamp"),
        field("state.curls.correct").cast("bigint").alias("correct"),
        field("feedback.total_windows").cast("bigint").alias("total_windows"),
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_texts(_analysis(spark, sf_dir).summaries)


def timeline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("session_uuid", "session_instance", "timeline")


def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("session_uuid", "session_instance", "summary_text")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("session_uuid", "session_instance", "prompt")


def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares such as 123/200 as text, most of them just beside a tie."""
    events = configure(spark).read.parquet(f"{sf_dir}/events.parquet")
    share = (F.get_json_object("props", "$.k").cast("double") * 2 + 1) / F.lit(200.0)
    return events.select(
        "event_id", fixed_text(share, 2).alias("share"), fixed_text(share * F.lit(100.0), 1).alias("percent")
    )


def stub_scorer(prompts: pd.Series, language: str) -> pd.Series:
    """Deterministic stand-in for a model; prompts of a length divisible by 5 get no JSON."""

    def reply(prompt: str) -> str:
        n = len(prompt)
        if n % 5 == 0:
            return "no analysis"
        return (
            '{"safety_analysis":{"status":"safe","risk_level":%d},'
            '"performance_analysis":{"quality_score":%d},"reasoning":"%s %d"}'
        ) % (n % 10 + 1, n % 7 + 1, language, n)

    return prompts.map(reply)


def analysis_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _texts(spark, sf_dir).select("session_uuid", "session_instance", "prompt")
    scored = score_prompts(asked, stub_scorer)
    return scored.withColumn("a", parse_analysis(F.col("reply"))).select(
        "session_uuid",
        "session_instance",
        F.col("a.safety_analysis.status").alias("status"),
        F.col("a.safety_analysis.risk_level").alias("risk_level"),
        F.col("a.performance_analysis.quality_score").alias("quality_score"),
        F.col("a.reasoning").alias("reasoning"),
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames processed and sessions touched per second of event time."""
    classified = _classified(spark, sf_dir)
    return classified.groupBy(F.expr("ts_ms div 1000").alias("second")).agg(
        F.count("*").alias("frames_processed"),
        F.count_if("bad_posture").alias("bad_posture_frames"),
        F.countDistinct("session_uuid").alias("active_sessions"),
    )


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def _replayed(spark: SparkSession, sf_dir: str, exercise: str | None = "dumbbell-arm") -> DataFrame:
    """The events table as a stream of frames."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return frames_of(source, exercise)


def _end_frame(spark: SparkSession) -> DataFrame:
    """A frame far in the future, which lets the watermark pass the last real one."""
    own = {
        "frame_track_uuid": F.lit("end"),
        "timestamp": F.timestamp_micros(F.lit(EPOCH_US + 10**12)),
        "exercise": F.lit("dumbbell-arm"),
        "session_uuid": F.lit(END_SESSION),
    }
    columns = [own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FRAME]
    return spark.range(1).select(*columns, F.lit(0).alias("level"))


def _ended(frames: DataFrame, folder: str) -> DataFrame:
    """The stream with the end frame, from a file of its own."""
    spark = frames.sparkSession
    end = _end_frame(spark).select(*frames.columns)
    end.coalesce(1).write.parquet(f"{folder}/end")
    return frames.unionByName(spark.readStream.schema(end.schema).parquet(f"{folder}/end"))


def _run(events: DataFrame, folder: str) -> DataFrame:
    """Run a stream of events until its input is used up and read its output back."""
    write_stream(events, f"{folder}/events", f"{folder}/checkpoint", once=True).awaitTermination()
    found = events.sparkSession.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events")
    return found.filter(F.col("session_uuid") != END_SESSION)


def _stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay the events table through the streaming engine and read its output back."""
    folder = _new_folder(configure(spark))
    frames = _ended(_replayed(spark, sf_dir), folder)
    return _run(session_events(frames, builtin_catalog(spark), F.col("level")), folder)


def _slices(spark: SparkSession, sf_dir: str, folder: str, bounds_s: list[float]) -> Iterator[int]:
    """Store the frames in slices of event time, one after the other: a stream run in between takes a slice a micro-batch."""
    frames = events_frames(spark, sf_dir)
    elapsed = F.unix_micros("timestamp") - EPOCH_US
    for n, (low, high) in enumerate(zip([float("-inf"), *bounds_s], [*bounds_s, float("inf")])):
        frames.filter((elapsed >= low * 1e6) & (elapsed < high * 1e6)).write.mode("append").parquet(f"{folder}/frames")
        yield n


def _sliced_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/frames").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/frames")


def stream_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are closed, forgotten and opened again while the stream goes on: their instances go on counting."""
    folder = _new_folder(configure(spark))

    def go_on() -> DataFrame:
        events = session_events(
            _sliced_stream(spark, folder),
            builtin_catalog(spark),
            F.col("level"),
            timeout_s=SHORT_TIMEOUT_S,
            forget_after_s=SHORT_TIMEOUT_S + 1,
        )
        return _run(events, folder)

    for _ in _slices(spark, sf_dir, folder, [12, 24, 36, 48, 60]):
        go_on()
    _end_frame(spark).coalesce(1).write.mode("append").parquet(f"{folder}/frames")
    return events_of(go_on(), "report").select("session_uuid", "session_instance", "status", "n_frames")


def _changed_document() -> str:
    """The rules after the change: the arm counts as stretched beyond 100 degrees already."""
    document = json.loads((BUILTIN_FOLDER / "dumbbell-arm.json").read_text(encoding="utf-8"))
    for machine in document["state_machine"].values():
        for state in machine["states"]:
            state["condition"] = state["condition"].replace("110", "100")
    return json.dumps(document)


def stream_catalog_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions while the rules change: each frame is judged by the version valid at its time."""
    folder = _new_folder(configure(spark))
    first = (BUILTIN_FOLDER / "dumbbell-arm.json").read_text(encoding="utf-8")

    def publish(from_s: int, text: str) -> None:
        row = spark.range(1).select(
            F.lit("dumbbell-arm").alias("exercise"),
            F.timestamp_micros(F.lit(EPOCH_US + from_s * 1_000_000)).alias("valid_from"),
            F.lit(text).alias("text"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{folder}/versions")

    publish(0, first)
    for n in _slices(spark, sf_dir, folder, [RULES_CHANGE_S]):
        if n:
            publish(RULES_CHANGE_S, _changed_document())
        judge_stream(
            _sliced_stream(spark, folder),
            lambda session: version_table(session, f"{folder}/versions"),
            f"{folder}/judged",
            f"{folder}/judging",
            F.col("level"),
            once=True,
        ).awaitTermination()
    end = compact_frames(_end_frame(spark), F.col("level"), keep=("timestamp",))
    end = classify(end, builtin_catalog(spark), keep_rejects=True, limits=True).drop("angles")
    end.coalesce(1).write.parquet(f"{folder}/judged/batch=999999999")
    events = fold_stream(judged_frames(spark, f"{folder}/judged", PROCESSING_DELAY_S))
    return events_of(_run(events, folder), "rep").select(
        "session_uuid", "session_instance", "ts_us", "frame_track_uuid", "rep"
    )


def _faulty_frames(frames: DataFrame) -> DataFrame:
    """Two event types have rules; a quarter each of the frames lacks the elbow or the offset angle."""
    known = F.when(F.col("exercise").isin("click", "view"), F.lit("dumbbell-arm")).otherwise(F.col("exercise"))
    number = F.substring("frame_track_uuid", 3, 20).cast("bigint") % 4
    lacking = F.when(number == 1, F.lit("elbow_angle")).when(number == 2, F.lit("offset_angle")).otherwise(F.lit(""))
    angles = F.filter("metrics.angles", lambda a: a["name"] != lacking)
    return frames.withColumn("exercise", known).withColumn("metrics", F.col("metrics").withField("angles", angles))


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that the rules cannot judge, with the reason, out of the query that folds the others."""
    folder = _new_folder(configure(spark))
    frames = _ended(_faulty_frames(_replayed(spark, sf_dir, None)), folder)
    events = _run(session_events(frames, builtin_catalog(spark), F.col("level")), folder)
    return events_of(events, "reject").select("session_uuid", "frame_track_uuid", "exercise", "reject_reason")


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener has noted of a stream with faulty frames: processed, rejected (the end frame both times, as it has no angles), too late."""
    folder = _new_folder(configure(spark))
    frames = _ended(_faulty_frames(_replayed(spark, sf_dir, None)), folder)
    metrics = RunMetrics()
    spark.streams.addListener(metrics)
    try:
        events = session_events(frames, builtin_catalog(spark), F.col("level"))
        query = write_stream(events, f"{folder}/events", f"{folder}/checkpoint", once=True)
        query.awaitTermination()
        metrics.wait_for(str(query.runId))
    finally:
        spark.streams.removeListener(metrics)
    metrics.write(spark, f"{folder}/metrics")
    return (
        spark.read.parquet(f"{folder}/metrics")
        .filter(F.col("run_id") == str(query.runId))
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("frames_processed", "frames_rejected", "rows_too_late")])
    )


def stream_report_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _message_fields(report_messages(report_rows(_stream_events(spark, sf_dir))))


def stream_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(_stream_events(spark, sf_dir), "rep").select(
        "session_uuid", "session_instance", "ts_us", "frame_track_uuid", "rep"
    )


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_windows(events_of(_stream_events(spark, sf_dir), "window"))


def stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(_stream_events(spark, sf_dir), "report").select(
        "session_uuid",
        "session_instance",
        "status",
        "exercise",
        F.col("ts_us").alias("last_us"),
        "correct",
        "incorrect",
        "total_windows",
        "exercise_duration",
        F.array_join(F.transform("feedback_summary", lambda i: i["id"]), ",").alias("issues"),
    )


QUERIES: dict[str, Query] = {
    "frame_parse_rejects": frame_parse_rejects,
    "frames_parsed": frames_parsed,
    "frames_dedup": frames_dedup,
    "buffer_retention": buffer_retention,
    "frames_range": frames_range,
    "incremental_consume": incremental_consume,
    "buffer_remaining": buffer_remaining,
    "consume_cursors": consume_cursors,
    "late_frames": late_frames,
    "active_sessions": active_sessions,
    "latest_frame": latest_frame,
    "clean_old_frames": clean_old_frames,
    "idle_gaps": idle_gap_list,
    "frame_angles": frame_angle_values,
    "posture_flags": posture_flags,
    "frame_states": frame_states,
    "session_exercise": session_exercises,
    "unknown_exercise": unknown_exercises,
    "frame_rule_rejects": frame_rule_rejects,
    "frame_violations": frame_violation_list,
    "frame_feedback": frame_feedback,
    "frame_feedback_catalog": frame_feedback_catalog,
    "feedback_messages": feedback_messages,
    "rep_counts": rep_counts,
    "rep_correctness": rep_correctness,
    "inactivity_resets": inactivity_resets,
    "posture_resets": posture_resets,
    "session_state": session_state,
    "session_state_ttl": session_state_ttl,
    "feedback_windows": feedback_window_rows,
    "feedback_windows_low_share": feedback_windows_low_share,
    "feedback_summary": feedback_summary,
    "issue_tiers": issue_tiers,
    "exercise_summary": exercise_summary,
    "session_lifecycle": lifecycle,
    "reopened_exercise": reopened_exercises,
    "analysis_rejects": analysis_rejects,
    "session_reports": session_report_rows,
    "running_sessions": running_sessions,
    "report_messages": report_message_values,
    "share_text": share_texts,
    "timeline_text": timeline_texts,
    "summary_text": summary_texts,
    "prompt": prompts,
    "analysis_parsed": analysis_parsed,
    "run_metrics": run_metrics,
    "stream_reps": stream_reps,
    "stream_windows": stream_windows,
    "stream_reports": stream_reports,
    "stream_reopened": stream_reopened,
    "stream_catalog_change": stream_catalog_change,
    "stream_rejects": stream_rejects,
    "stream_metrics": stream_metrics,
    "stream_report_messages": stream_report_messages,
    "catalog_rules": catalog_rules,
}
