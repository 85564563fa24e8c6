"""Catalog, parsing, classification, buffer and text on small fixtures."""

import datetime
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poselytics.functions.rules import NO_STATE, first_state_sql, state_terms
from poselytics.functions.text import parse_analysis, score_prompts, summary_text, timeline_text
from poselytics.operators import buffer
from poselytics.operators.classify import classify, compact_frames
from poselytics.sources.catalog import (
    BUILTIN_FOLDER,
    TERM,
    builtin_catalog,
    catalog_from_documents,
    message_for,
    read_catalog,
)
from poselytics.sources.events import events_frames
from poselytics.sources.frames import parse_frames, read_frames, rejected_frames, valid_frames
from tests.conftest import SMALL

COMPACT = (
    "session_uuid string, ts_ms bigint, frame_track_uuid string, ts_us bigint, exercise string, level int, "
    "angles map<string,double>, is_complete boolean"
)


def compact_of(spark, angle_maps, exercise="dumbbell-arm"):
    data = [("s", i, str(i), i * 1000, exercise, 0, angles, False) for i, angles in enumerate(angle_maps)]
    return spark.createDataFrame(data, COMPACT)


def test_catalog_tables_from_a_folder(spark, tmp_path):
    text = (BUILTIN_FOLDER / "dumbbell-arm.json").read_text()
    (tmp_path / "curl.json").write_text(text)
    (tmp_path / "broken.json").write_text(text[:-20])
    incomplete = json.loads(text)
    del incomplete["inactivity_time"]
    (tmp_path / "incomplete.json").write_text(json.dumps(incomplete))
    (tmp_path / "notes.txt").write_text("not a catalog file")
    catalog = read_catalog(spark, str(tmp_path))
    assert [(r.exercise, r.level) for r in catalog.rules] == [("curl", 0), ("curl", 1)]
    assert catalog.state_rules.count() == 6
    assert catalog.threshold_rules.count() == 8
    assert catalog.success_sequences.filter("level = 1").first().success_sequence == ["s1", "s2", "s3", "s1"]
    limits = {r.level: (r.offset_angle, r.offset_thresh, r.inactive_thresh) for r in catalog.limits.collect()}
    assert limits == {0: ("offset_angle", 45.0, 25.0), 1: ("offset_angle", 45.0, 15.0)}
    assert message_for(catalog, "curl", "hand_too_far").first().severity == "critical"
    assert message_for(catalog, "curl", "nothing").count() == 0


def test_rules_by_hand(spark):
    nan = float("nan")
    cases = [
        ((45.0, 45.0), "s3", ["lower_wrist", "keep_hand_near", "hand_too_far"], True),
        ((65.0, 20.0), "s3", ["raise_wrist"], False),
        ((55.0, 38.0), "s3", ["keep_hand_near"], False),
        ((55.0, 20.0), "s3", [], False),
        ((120.0, 45.0), "s1", [], False),
        ((nan, 20.0), None, [], False),
    ]
    compact = compact_of(
        spark, [{"elbow_angle": e, "shoulder_angle": s, "offset_angle": 0.0} for (e, s), *_ in cases]
    )
    found = classify(compact, builtin_catalog(spark)).orderBy("ts_ms").collect()
    assert [(r.state, r.feedback_ids, r.critical) for r in found] == [tuple(c[1:]) for c in cases]


def test_missing_angles_and_unknown_exercises(spark):
    catalog = builtin_catalog(spark)
    angles = [
        {"elbow_angle": 55.0, "offset_angle": 0.0},  # an absent threshold angle is skipped
        {"elbow_angle": 55.0, "shoulder_angle": 20.0},  # no offset angle
        {"shoulder_angle": 20.0, "offset_angle": 0.0},  # no angle for the states
        {"shoulder_angle": 20.0, "offset_angle": -50.0},  # posture is judged first
    ]
    found = classify(compact_of(spark, angles), catalog, keep_rejects=True).orderBy("ts_ms").collect()
    assert [r.reject_reason for r in found] == [None, "missing_angle", "missing_angle", None]
    assert [r.bad_posture for r in found] == [False, False, False, True]
    unknown = classify(compact_of(spark, angles[:1], "squat"), catalog, keep_rejects=True).first()
    assert unknown.reject_reason == "unknown_exercise"
    assert classify(compact_of(spark, angles, "squat"), catalog).count() == 0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a > 1 and b < 2", [True, False, False]),
        ("1 < a <= 2", [True, False, False]),
        ("not (a > 1)", [False, True, True]),
        ("a != 2", [False, True, True]),
        ("a + b / 2 >= 2.5 or a == 0", [True, True, False]),
        ("-a < -1", [True, False, False]),
        ("a % 3 == 2", [True, False, False]),
        ("(a - 3) % 5 == 4", [True, False, False]),
        ("(b - 4) % -3 > -2 and a ** 2 >= 0", [True, False, False]),
    ],
)
def test_condition_text(spark, text, expected):
    nan = float("nan")
    df = spark.createDataFrame([(0, 2.0, 1.0), (1, 0.0, 5.0), (2, nan, 1.0)], "i int, a double, b double")
    terms = pa.table({"terms": pa.array([state_terms([text])], pa.list_(TERM))})
    df = df.crossJoin(spark.createDataFrame(terms))
    at = first_state_sql("terms", "map('a', a, 'b', b)")
    assert [r.x for r in df.orderBy("i").selectExpr(f"{at} < {NO_STATE} AS x").collect()] == expected


def test_only_what_decides_is_read(spark):
    conditions = ["a > 5 or b > 1", "not (a > 2 and c > 1)", "d > 1"]
    terms = pa.table({"terms": pa.array([state_terms(conditions)], pa.list_(TERM))})
    rows = [{"a": 6.0}, {"a": 1.0, "b": 0.0}, {"a": 3.0, "b": 0.0}, {"a": 3.0, "b": 0.0, "c": 2.0, "d": 0.0}, {}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, m map<string, double>")
    at = first_state_sql("terms", "m")
    found = df.crossJoin(spark.createDataFrame(terms)).orderBy("i").selectExpr(f"{at} AS x").collect()
    assert [r.x for r in found] == [NO_STATE - 1, NO_STATE - 2, None, NO_STATE, None]


@pytest.mark.parametrize("text", ["__import__('os')", "a.b > 1", "a", "a > 'x'", "a in (1, 2)", "f(a) > 1"])
def test_condition_text_cannot_run_code(text):
    with pytest.raises(ValueError):
        state_terms([text])


def test_parse_and_rejects(spark):
    point = {"x": 1, "y": 2}
    good = {
        "frame_track_uuid": "f",
        "timestamp": "2024-01-01T00:00:01.5+02:00",
        "exercise": "e",
        "video_duration": None,
        "session_uuid": "s",
        "landmarks": [point],
        "metrics": {
            "angles": [{"name": "a", "value": 90, "point1": point, "point2": point, "ref_point": point}],
            "dominant_side": {"side": "left", "probability": None},
        },
        "current_time": 3,
    }
    old = {
        "frame_track_uuid": "old-7",
        "timestamp": "2023-06-05T08:30:00",
        "exercise": "side-plank",
        "session_uuid": "hall-3",
        "landmarks": [{"x": 0.5, "y": 0.25, "z": 0}],
        "metrics": {"knee": 61},
    }
    messages = [json.dumps(good), json.dumps(old), "[1]", "{", json.dumps({**good, "session_uuid": None})]
    parsed = parse_frames(spark.createDataFrame([(m,) for m in messages], "value string")).cache()
    row = valid_frames(parsed).select("*", F.unix_micros("timestamp").alias("us")).collect()
    assert len(row) == 1 and row[0].us == 1704060001500000 and row[0].video_duration is None
    assert sorted(r.reject_reason for r in rejected_frames(parsed).collect()) == [
        "bad_json",
        "bad_json",
        "invalid_session_uuid",
        "missing_video_duration",
    ]


def test_the_scan_reads_only_what_is_used(spark, tmp_path, capsys):
    path = str(tmp_path / "frames")
    events_frames(spark, SMALL).drop("level").write.parquet(path)
    recent = read_frames(spark, path).filter(F.col("timestamp") > F.lit("2024-01-01 00:00:30").cast("timestamp"))
    classify(compact_frames(recent), builtin_catalog(spark)).explain("formatted")
    plan = capsys.readouterr().out
    schema = plan[plan.rindex("ReadSchema") :].split("\n")[0]
    assert "angles:array<struct<name:string,value:double>>" in schema
    assert "landmarks" not in schema and "point1" not in schema and "dominant_side" not in schema
    assert "GreaterThan(timestamp" in plan
    assert "Exchange hashpartitioning" not in plan


def test_retention_by_arrival(spark):
    arrivals = [("s", 0, 1), ("s", 10_000, 2), ("s", 31_000, 3), ("s", 5_000, 4), ("t", 0, 1), ("t", 30_000, 2)]
    df = spark.createDataFrame(arrivals, "session_uuid string, ts_ms bigint, arrival_seq bigint")
    for n_chunks in (1, 4):
        evicted = buffer.retention(df, n_chunks=n_chunks).filter("is_evicted").collect()
        assert sorted((r.session_uuid, r.ts_ms) for r in evicted) == [("s", 0), ("t", 0)]


def test_retention_machine_in_pieces():
    rng = random.Random(5)
    for retention in (0, 7, 30):
        machine = buffer.RetentionMachine(retention)
        times = [rng.randrange(-5, 100) for _ in range(200)]
        expected = [any(u - retention >= t for u in times[:k]) and t >= 0 for k, t in enumerate(times)]
        for cuts in ([0, 200], [0, 1, 1, 60, 199, 200]):
            state, out = None, {"is_evicted": []}
            for lo, hi in zip(cuts, cuts[1:]):
                state = machine.run(state, {"ts_ms": times}, lo, hi, out)
            assert out["is_evicted"] == expected and state == max(times)


def test_consume(spark):
    frames = spark.createDataFrame(
        [("s", t) for t in (19_999, 20_000, 20_001, 30_000, 30_001)], "session_uuid string, ts_ms bigint"
    )
    cursors = spark.createDataFrame([("s", 20_000), ("t", 5)], "session_uuid string, last_ms bigint")
    consumed = buffer.consume(frames, cursors, 40_000)
    assert sorted(r.ts_ms for r in consumed.collect()) == [20_001, 30_000]
    assert sorted(r.ts_ms for r in buffer.late_frames(frames, cursors).collect()) == [19_999, 20_000]
    moved = {r.session_uuid: r.last_ms for r in buffer.advance_cursors(consumed, cursors, 40_000).collect()}
    assert moved == {"s": 30_000, "t": 5}
    later = buffer.consume(frames, spark.createDataFrame([("s", 30_000)], cursors.schema), 41_000)
    assert [r.ts_ms for r in later.collect()] == [30_001]


def test_narrow_dedup(spark):
    schema = "session_uuid string, at timestamp, landmarks array<struct<x:double,y:double>>, side map<string,int>"
    at, later = datetime.datetime(2024, 5, 1, 8, 0, 0, 100), datetime.datetime(2024, 5, 1, 8, 0, 0, 101)
    rows = [
        ("s", at, [(1.0, None)], {"a": 1}),
        ("s", at, [(None, 1.0)], {"a": 1}),
        ("s", at, [(1.0, None)], None),
        ("s", at, [], {"a": 1}),
        ("s", at, None, {"a": 1}),
        ("s", later, None, {"a": 1}),
        (None, None, None, None),
    ]
    frames = spark.createDataFrame(rows + rows[::-1], schema).repartition(3)
    unique = buffer.dedup_frames(frames, ["session_uuid"])
    assert sorted((r.session_uuid or "") for r in unique.collect()) == ["", *["s"] * 6]
    plan = unique._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("landmarks" in line or "side" in line for line in shuffled)
    assert buffer.dedup_frames(frames.limit(0), ["session_uuid"]).count() == 0
    assert buffer.dedup_frames(frames.select("session_uuid"), ["session_uuid"]).count() == 2  # nothing is left for the digest


def test_latest_and_old_frames(spark):
    frames = spark.createDataFrame(
        [("hall-3", 0, "a", 0), ("hall-3", 10_000, "b", 10_000_000), ("hall-4", 5, "a", 5_000)],
        "session_uuid string, ts_ms bigint, frame_track_uuid string, ts_us bigint",
    )
    latest = {r.session_uuid: r.frame.frame_track_uuid for r in buffer.latest_frames(frames).collect()}
    assert latest == {"hall-3": "b", "hall-4": "a"}
    assert buffer.latest_frames(frames.filter("session_uuid = 'empty'")).count() == 0
    tied = frames.unionByName(frames).union(spark.createDataFrame([("hall-4", 5, "a", 5_400), (None, None, "c", None)], frames.schema))
    latest = {r.session_uuid: tuple(r.frame) for r in buffer.latest_frames(tied).collect()}
    assert latest == {"hall-3": ("hall-3", 10_000, "b", 10_000_000), "hall-4": ("hall-4", 5, "a", 5_400), None: (None, None, "c", None)}
    kept = buffer.clean_old_frames(frames, 40_000, 30)
    assert kept.count() == 0  # exactly as old as allowed is too old
    assert buffer.clean_old_frames(frames, 39_999, 30).count() == 1


def test_texts(spark):
    window = "array<struct<start_us:bigint,end_us:bigint,feedback:array<struct<id:string,count:bigint,frame_ratio:double>>>>"
    issue = "array<struct<id:string,window_ratio:double>>"
    row = (
        [(0, 2_500_000, [("a", 5, 0.625)]), (2_500_000, 5_000_000, []), (6_250_000, 8_750_000, [("b", 1, 1.0)])],
        [("a", 0.0625), ("b", 1.0)],
    )
    df = spark.createDataFrame([row], f"windows {window}, issues {issue}")
    text = df.select(timeline_text(F.col("windows")).alias("t"), summary_text(F.col("issues")).alias("s")).first()
    assert text.t == "Time 0.0-2.5s:\n- a (persistence: 0.62)\n\nTime 6.2-8.8s:\n- b (persistence: 1.00)"
    assert text.s == "- a: occurred in 6.2% of exercise time\n- b: occurred in 100.0% of exercise time"


def test_scorer_hook(spark):
    df = spark.createDataFrame([("one",), (None,)], "prompt string")
    assert score_prompts(df, None).columns == ["prompt"]

    def failing(prompts, language):
        raise RuntimeError("model down")

    assert {r.reply for r in score_prompts(df, failing).collect()} == {None}
    scored = score_prompts(df, lambda prompts, language: prompts + language, "en")
    assert {r.reply for r in scored.collect()} == {"oneen", None}
    parsed = spark.createDataFrame([('{"reasoning":"ok"}',), ("no",), (None,)], "reply string").select(
        parse_analysis(F.col("reply")).alias("a")
    )
    assert [r.a.reasoning if r.a else None for r in parsed.collect()] == ["ok", None, None]


def test_catalog_documents_with_other_rules(spark):
    document = json.loads((BUILTIN_FOLDER / "dumbbell-arm.json").read_text())
    document["angles"] = [{"name": "elbow_angle"}]  # no offset angle: the posture check is off
    document["thresholds"]["beginner"]["angle_thresh"] = {}
    catalog = catalog_from_documents(spark, {"it's": json.dumps(document)})
    row = classify(compact_of(spark, [{"elbow_angle": 55.0}], "it's"), catalog).first()
    assert (row.bad_posture, row.state, row.feedback_ids) == (False, "s3", [])
