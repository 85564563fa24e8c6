"""Streaming over several micro-batches gives what the batch engine gives."""

import json
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from poselytics.operators.classify import classify, compact_frames
from poselytics.operators.feedback import feedback_windows
from poselytics.operators.lifecycle import order_frames, with_lifecycle
from poselytics.operators.session_fold import fold_rules, rep_events, session_states, session_trace
from poselytics.plans.analysis import SessionAnalysis
from poselytics.plans.queries import _slices
from poselytics.schema import FRAME
from poselytics.sources.catalog import BUILTIN_FOLDER, builtin_catalog, read_catalog_versions, write_documents
from poselytics.sources.events import EPOCH_US, events_frames
from poselytics.sources.frames import parse_frames, stream_messages, valid_frames
from poselytics.sources.sinks import report_messages
from poselytics.streaming.jobs import RunMetrics, for_each_catalog, write_stream
from poselytics.streaming.sessions import EVENT_SCHEMA, SessionProcessor, dedup_stream, events_of, judged_texts, report_rows, session_events
from tests.conftest import SMALL


def test_stream_equals_batch(spark, tmp_path):
    frames = events_frames(spark, SMALL).drop("level").cache()
    # files in time order, rows inside a file in any order; the last file ends the stream
    elapsed = F.unix_micros("timestamp") - EPOCH_US
    source = tmp_path / "frames"
    for part in range(3):
        piece = frames.filter((elapsed >= part * 24_000_000) & (elapsed < (part + 1) * 24_000_000))
        piece.orderBy(F.hash("frame_track_uuid")).coalesce(1).write.mode("append").parquet(str(source))
    end = frames.limit(1).withColumn("session_uuid", F.lit("end")).withColumn(
        "timestamp", F.timestamp_micros(F.lit(EPOCH_US + 10**12))
    )
    end.coalesce(1).write.mode("append").parquet(str(source))

    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(source))
    catalog = builtin_catalog(spark)
    query = write_stream(
        session_events(dedup_stream(stream), catalog, watermarked=True, state_ttl_s=3.0),
        str(tmp_path / "events"),
        str(tmp_path / "checkpoint"),
        once=True,
    )
    query.awaitTermination()
    events = spark.read.schema(EVENT_SCHEMA).parquet(str(tmp_path / "events")).filter("session_uuid <> 'end'")

    trace = session_trace(with_lifecycle(order_frames(compact_frames(frames)), state_ttl_s=3.0), catalog)
    key = ["session_uuid", "session_instance"]

    def rows(df, *columns):
        return sorted(tuple(map(str, r)) for r in df.select(*key, *columns).collect())

    assert rows(events_of(events, "rep"), "ts_us", "rep") == rows(rep_events(trace), "ts_us", "rep")
    assert rows(events_of(events, "window"), "start_us", "end_us", "feedback") == rows(
        feedback_windows(trace), "start_us", "end_us", "feedback"
    )
    assert rows(events_of(events, "report"), "correct", "incorrect") == rows(
        session_states(trace), "correct", "incorrect"
    )


def test_catalog_is_read_again_for_each_batch(spark, tmp_path):
    point = {"x": 1, "y": 2}
    names = {"elbow_angle": 55.0, "shoulder_angle": 20.0, "offset_angle": 0.0}
    angles = [
        {"name": n, "value": v, "point1": point, "point2": point, "ref_point": point} for n, v in names.items()
    ]
    message = {
        "frame_track_uuid": "f",
        "timestamp": "2024-01-01T00:00:00",
        "exercise": "dumbbell-arm",
        "video_duration": 60,
        "session_uuid": "s",
        "landmarks": [],
        "metrics": {"angles": angles, "dominant_side": {"side": "left", "probability": 0.5}},
        "current_time": 1,
    }
    source, catalog = tmp_path / "messages", tmp_path / "catalog"
    source.mkdir()
    catalog.mkdir()
    document = json.loads((BUILTIN_FOLDER / "dumbbell-arm.json").read_text())
    seen = []

    def sink(batch, _):
        seen.extend(r.state for r in batch.select("state").collect())

    for i, state in enumerate(["s3", "changed"]):
        document["state_machine"]["beginner"]["states"][2]["id"] = state
        (catalog / "dumbbell-arm.json").write_text(json.dumps(document))
        (source / f"{i}.json").write_text(json.dumps({**message, "frame_track_uuid": str(i)}) + "\nnot json\n")
        frames = valid_frames(parse_frames(stream_messages(spark, str(source))))
        query = for_each_catalog(frames, str(catalog), sink, str(tmp_path / "cp"), once=True)
        query.awaitTermination()
    assert seen == ["s3", "changed"]


def angles_of(elbow, shoulder, offset):
    values = {"elbow_angle": elbow, "shoulder_angle": shoulder, "offset_angle": offset}
    return [{"name": n, "value": v, "point1": None, "point2": None, "ref_point": None} for n, v in values.items() if v is not None]


def frame(k, at_s, session="s", elbow=120.0, offset=0.0, exercise="dumbbell-arm", current=1.0):
    stamp = datetime.fromtimestamp(1_704_067_200 + at_s, timezone.utc)
    metrics = {"angles": angles_of(elbow, 20.0, offset), "dominant_side": {"side": "left", "probability": None}}
    return (f"f{k}", stamp, exercise, 60.0, session, [], metrics, current)


def run_batches(spark, folder, batches, **options):
    """Events of a stream that takes each list of frames as one micro-batch, and what a listener noted."""
    for rows in batches:
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(f"{folder}/frames")
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(f"{folder}/frames")
    metrics = RunMetrics()
    spark.streams.addListener(metrics)
    query = write_stream(
        session_events(stream, builtin_catalog(spark), **options), f"{folder}/events", f"{folder}/checkpoint", once=True
    )
    query.awaitTermination()
    metrics.wait_for(str(query.runId))
    spark.streams.removeListener(metrics)
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events"), metrics


def test_messages_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    frames = events_frames(spark, SMALL).drop("level")
    rows = [tuple(r) for r in frames.collect()]
    rows.sort(key=lambda r: r[1])
    half = len(rows) // 2
    events, _ = run_batches(spark, tmp_path, [rows[:half], rows[half:], [frame(0, 10**6, "end")]])
    found = report_messages(report_rows(events.filter("session_uuid <> 'end'"))).collect()
    expected = report_messages(SessionAnalysis(frames, builtin_catalog(spark), dedup=False).reports()).collect()
    read = lambda rows: sorted(((r.key, json.loads(r.value)) for r in rows), key=lambda p: (p[0], p[1]["session_instance"]))
    pairs = list(zip(read(found), read(expected), strict=True))
    assert pairs and all(a == b for a, b in pairs)
    assert any(a[1]["feedback"]["windows"] for a, _ in pairs)


def test_every_frame_is_folded_rejected_or_late(spark, tmp_path):
    first = [frame(k, k) for k in range(40)] + [frame(100 + k, k, exercise="unknown") for k in range(5)]
    second = [frame(200 + k, 41 + k, elbow=None) for k in range(7)] + [frame(300 + k, 60 + k) for k in range(20)]
    late = [frame(400 + k, k) for k in range(3)] + [frame(500, 90)]
    events, metrics = run_batches(spark, tmp_path, [first, second, late, [frame(0, 10**6, "end")]])
    events = events.filter("session_uuid = 's'")
    rejects = {r.reject_reason: r.n for r in events_of(events, "reject").groupBy("reject_reason").agg(F.count("*").alias("n")).collect()}
    folded = events_of(events, "report").agg(F.sum("n_frames")).first()[0]
    too_late = sum(r[-1] for r in metrics.rows)
    assert rejects == {"unknown_exercise": 5, "missing_angle": 7} and too_late == 3
    assert folded + sum(rejects.values()) + too_late == len(first) + len(second) + len(late)
    assert sum(r[5] for r in metrics.rows) == 12
    metrics.write(spark, f"{tmp_path}/metrics")
    metrics.write(spark, f"{tmp_path}/metrics")  # nothing new
    assert spark.read.parquet(f"{tmp_path}/metrics").count() == len(metrics.rows)


def test_forgotten_sessions_go_on_counting(spark, tmp_path):
    clock = lambda at: frame(at, at, "clock")
    batches = [[frame(1, 0), frame(2, 1), clock(2)], [clock(200)], [frame(3, 205), clock(206)], [clock(400)], [frame(4, 410)], [clock(5000)], [clock(7000)], [clock(7100)], [frame(5, 7110)], [clock(10**6)], [clock(10**6 + 20)]]
    events, _ = run_batches(spark, tmp_path, batches, timeout_s=5.0, forget_after_s=20.0, tombstone_s=1000.0)
    found = sorted((r.session_instance, r.n_frames) for r in events_of(events, "report").filter("session_uuid = 's'").collect())
    # the last came when even the number was forgotten
    assert found == [(0, 1), (0, 2), (1, 1), (2, 1)]


def test_waiting_frames_in_small_buckets(spark, tmp_path):
    rows = [frame(k, k * 0.25, elbow=[120.0, 90.0, 50.0, 90.0][k // 2 % 4]) for k in range(400)]
    batches = [sorted(rows[k : k + 90], key=lambda r: r[0]) for k in range(0, 400, 90)] + [[frame(0, 10**6, "end")]]
    results = []
    for bucket in (0.5, 1000.0):
        events, _ = run_batches(spark, tmp_path / str(bucket), batches, bucket_s=bucket)
        results.append(sorted(map(str, events.filter("session_uuid = 's'").collect())))
    assert results[0] == results[1] and len(results[0]) > 50


def test_versions_of_a_folder(spark, tmp_path):
    text = (BUILTIN_FOLDER / "dumbbell-arm.json").read_text(encoding="utf-8")
    faulty = text.replace('"elbow_angle > 110"', '"elbow_angle.x > 110"')
    for name, content in (("2024-01-01", text), ("2024-01-02", faulty), ("2024-01-03", text.replace("110", "100"))):
        write_documents(spark, f"{tmp_path}/valid_from={name}", {"dumbbell-arm": content})
    catalog = read_catalog_versions(spark, str(tmp_path))
    day = 86_400 * 10**6
    spans = {(r.level, (r.valid_from_us - EPOCH_US) // day, r.valid_until_us and (r.valid_until_us - EPOCH_US) // day) for r in catalog.rules}
    assert spans == {(level, *span) for level in (0, 1) for span in ((0, 2), (2, None))}
    assert list(catalog.invalid) == [f"dumbbell-arm@{EPOCH_US + day}"]
    rows = [frame(n, at * 86_400 + 1, elbow=105.0) for n, at in enumerate((-1, 0, 1, 2, 9))]
    judged = classify(compact_frames(spark.createDataFrame(rows, FRAME)), catalog, keep_rejects=True)
    found = [(r.state, r.reject_reason) for r in judged.orderBy("ts_us").collect()]
    assert found == [(None, "unknown_exercise"), ("s2", None), ("s2", None), ("s1", None), ("s1", None)]
    with pytest.raises(ValueError):
        fold_rules(catalog)


class CountedState:
    """What the engine keeps for one session, in memory; each call is noted."""

    def __init__(self):
        self.calls, self.held, self.timers = [], {}, set()

    def getMapState(self, name, *_):
        return CountedVariable(self, name)

    getListState = getValueState = getMapState

    def registerTimer(self, at_ms):
        self.calls.append("registerTimer")
        self.timers.add(at_ms)

    def deleteTimer(self, at_ms):
        self.calls.append("deleteTimer")
        self.timers.remove(at_ms)


class CountedVariable:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def _kept(self, empty):
        return self.state.held.setdefault(self.name, empty)

    def __getattr__(self, call):
        self.state.calls.append(f"{self.name}.{call}")
        return {
            "get": lambda: self.state.held.get(self.name),
            "exists": lambda: self.name in self.state.held,
            "update": lambda value: self.state.held.update({self.name: value}),
            "clear": lambda: self.state.held.pop(self.name, None),
            "keys": lambda: list(self._kept({})),
            "containsKey": lambda key: key in self._kept({}),
            "getValue": lambda key: self._kept({}).get(key),
            "updateValue": lambda key, value: self._kept({}).update({key: value}),
            "removeKey": lambda key: self._kept({}).pop(key),
            "appendList": lambda values: self._kept([]).extend(values),
        }[call]


def test_a_session_takes_few_calls_and_few_data_frames(spark):
    """Each state call and each yielded frame has a fixed price, which sessions of some dozen frames pay by number."""
    stamp = lambda at: datetime.fromtimestamp(1_704_067_200 + at, timezone.utc)
    cycle = [120.0, 90.0, 50.0, 90.0]
    rows = [frame(k, k, elbow=cycle[k // 2 % 4]) for k in range(72)]
    judged = classify(compact_frames(spark.createDataFrame(rows, FRAME), keep=("timestamp",)), builtin_catalog(spark), keep_rejects=True, limits=True)
    batch = judged_texts(judged).toPandas()
    state, processor = CountedState(), SessionProcessor()
    processor.init(state)
    state.calls.clear()
    out = list(processor.handleInputRows(("s",), iter([batch]), None))
    for at_s in (5, 40, 10**5):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda at_s=at_s: round(stamp(at_s).timestamp() * 1000))
        for due in [t for t in state.timers if t <= now.getCurrentWatermarkInMs()]:
            out += processor.handleExpiredTimer(("s",), now, None)
            state.timers.discard(due)  # as the engine does
    events = [json.loads(text) for found in out for text in found["event"]]
    kinds = [event["kind"] for event in events]
    assert kinds.count("report") == 1 and events[-1]["n_frames"] == 72
    assert kinds.count("window") == len(events[-1]["windows"]) > 10 and state.held.keys() == {"tombstone"} and kinds.count("rep") > 2
    # eight buckets of event time, three timers
    assert len(out) <= 3 and all(found.shape[1] == 1 for found in out)
    assert len(state.calls) <= 16


def test_frames_wait_in_the_record_or_in_buckets(spark, tmp_path):
    """The same events whether all, some or none of the waiting frames are kept apart."""
    rows = [frame(k, k * 0.25, elbow=[120.0, 90.0, 50.0, 90.0][k // 2 % 4], offset=60.0 * (k % 3)) for k in range(400)]
    batches = [rows[k : k + 90][::-1] for k in range(0, 400, 90)] + [[frame(0, 10**6, "end")]]
    results = []
    for near in (0, 60, 1000):
        events, _ = run_batches(spark, tmp_path / str(near), batches, near=near)
        results.append(sorted(map(str, events.filter("session_uuid = 's'").collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) > 40


def test_slices_are_stored_by_many_tasks(spark, tmp_path):
    """No slice passes one task; each holds its own time, and an empty one is one too."""
    names = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    for part in range(4):
        stamps = [datetime(2024, 1, 1 + day, part, tzinfo=timezone.utc) for day in range(20)]
        rows = [(part * 100 + n, at, n % 3, "view", 10.0, '{"k": 40}') for n, at in enumerate(stamps)]
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
    files = []
    for _ in _slices(spark, f"{tmp_path}/in", str(tmp_path), [24.0, 100.0]):
        files.append(len(list((tmp_path / "frames").glob("*.parquet"))))
    assert files[0] > 1 and files[1] > files[0] + 1 and files[2] > files[1]
    assert spark.read.parquet(f"{tmp_path}/frames").count() == 80
