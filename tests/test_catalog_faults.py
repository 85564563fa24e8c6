"""Broken catalog documents, long rule lists, exact fixed-point text."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from poselytics.functions.text import fixed_text
from poselytics.operators.classify import classify, compact_frames, rule_rejects
from poselytics.plans.analysis import SessionAnalysis
from poselytics.sources.catalog import BUILTIN_FOLDER, catalog_from_documents
from poselytics.sources.events import events_frames
from tests.conftest import SMALL

GOOD = json.loads((BUILTIN_FOLDER / "dumbbell-arm.json").read_text(encoding="utf-8"))


def broken(change):
    doc = copy.deepcopy(GOOD)
    change(doc)
    return json.dumps(doc)


def first_rule(doc):
    return next(iter(doc["thresholds"]["beginner"]["angle_thresh"].values()))[0]


FAULTS = {
    "no-inactive": (lambda d: d["thresholds"]["beginner"].pop("INACTIVE_THRESH"), "INACTIVE_THRESH"),
    "null-offset": (lambda d: d["thresholds"]["beginner"].update(OFFSET_THRESH=None), "OFFSET_THRESH"),
    "no-feedback": (lambda d: first_rule(d).pop("feedback"), "no feedback"),
    "unsupported": (lambda d: d["state_machine"]["pro"]["states"][0].update(condition="f(elbow_angle) > 1"), "unsupported"),
    "no-syntax": (lambda d: d["state_machine"]["pro"]["states"][0].update(condition="elbow_angle >"), "pro"),
    "no-condition": (lambda d: d["state_machine"]["pro"]["states"][0].update(condition=None), "condition"),
}


def test_bad_documents_leave_the_others_alone(spark):
    documents = {"click": json.dumps(GOOD)} | {name: broken(change) for name, (change, _) in FAULTS.items()}
    catalog = catalog_from_documents(spark, documents)
    assert {r.exercise for r in catalog.rules} == {"click"}
    assert set(catalog.invalid) == set(FAULTS)
    for name, (_, reason) in FAULTS.items():
        assert reason in catalog.invalid[name]
    compact = compact_frames(events_frames(spark, SMALL, None), F.col("level"))
    clicks = compact.filter("exercise = 'click'").count()
    assert classify(compact, catalog).count() == clicks > 0
    assert rule_rejects(compact, catalog).count() == compact.count() - clicks


@pytest.mark.parametrize("chunks", [1, 7])
def test_no_frame_is_lost(spark, chunks):
    catalog = catalog_from_documents(spark, {"click": json.dumps(GOOD), "view": json.dumps(GOOD)})
    frames = events_frames(spark, SMALL, None)
    found = SessionAnalysis(frames, catalog, F.col("level"), dedup=False, timeout_s=2.0, n_chunks=chunks)
    kept, rejected = found.trace.count(), found.rejects.count()
    assert kept > 0 and rejected > 0 and kept + rejected == frames.count()
    assert found.rejects.filter("reject_reason <> 'unknown_exercise'").isEmpty()


@pytest.mark.parametrize("stop", [True, False])
def test_many_critical_rules(spark, stop):
    doc = copy.deepcopy(GOOD)
    rng = random.Random(1)
    for level in doc["thresholds"].values():
        level["angle_thresh"] = {
            angle: [{"max": rng.randint(20, 150), "feedback": f"{angle}-{k}", "critical": k % 2 == 1} for k in range(12)]
            for angle in ("elbow_angle", "shoulder_angle")
        }
    catalog = catalog_from_documents(spark, {"dumbbell-arm": json.dumps(doc)})
    compact = compact_frames(events_frames(spark, SMALL), F.col("level"))
    judged = 0
    for row in classify(compact, catalog, stop_at_critical=stop).collect():
        expected, critical = [], False
        if not row.bad_posture and row.state != "s1":
            judged += 1
            thresholds = list(doc["thresholds"].values())[row.level]["angle_thresh"]
            for angle, rule in ((a, r) for a, rules in thresholds.items() for r in rules):
                if row.angles[angle] > rule["max"]:
                    expected.append(rule["feedback"])
                    critical = critical or rule["critical"]
                    if stop and rule["critical"]:
                        break
        assert (row.feedback_ids, row.critical) == (expected, critical)
    assert judged > 0


def test_fixed_text_is_exact(spark):
    rng = random.Random(2)
    values = [0.0, 0.615, 123 / 200, 0.125, 0.375, 0.005, 0.995, 0.9999, 1.0, 2.25, 2.35, 0.25, 99.95, 1704067200.25, 1e-20, -0.35]
    values += [rng.randint(0, 400) / rng.choice([200, 8, 7, 40]) for _ in range(2000)]
    values += [rng.randint(0, 10**9) / 1e6 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", fixed_text(F.col("v"), 1).alias("one"), fixed_text(F.col("v"), 2).alias("two")).collect():
        assert (row.one, row.two) == (f"{row.v:.1f}", f"{row.v:.2f}"), row.v
