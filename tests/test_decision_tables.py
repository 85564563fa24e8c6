"""Decision tables say what the rules say, walked one by one."""

import json

import pytest
from pyspark.sql import functions as F

from poselytics.functions import rules
from poselytics.operators.classify import classify
from poselytics.sources.catalog import BUILTIN_FOLDER, catalog_from_documents

NAN = float("nan")


def document(states, thresholds, angles=("a", "b", "offset")):
    document = json.loads((BUILTIN_FOLDER / "dumbbell-arm.json").read_text())
    document["angles"] = [{"name": n} for n in angles]
    level = {"states": [{"id": f"s{k + 1}", "condition": c} for k, c in enumerate(states)], "success_sequence": ["s1"]}
    document["state_machine"] = {"beginner": level, "pro": level}
    level = {"angle_thresh": thresholds, "OFFSET_THRESH": 45.0, "INACTIVE_THRESH": 25.0}
    document["thresholds"] = {"beginner": level, "pro": level}
    return json.dumps(document)


DOCUMENTS = {
    "plain": document(
        ["a > 110", "a <= 110 and b > 70.5", "not (b < 10 or a == 20) and 5 < a <= 60", "b != 10"],
        {"b": [{"min": 10, "max": 40, "feedback": "x"}, {"max": 40, "feedback": "y", "critical": True}], "c": [{"min": 1, "feedback": "z"}]},
    ),
    "sums": document(["a + b > 100", "a > 20"], {"a": [{"min": 20, "max": 30, "feedback": "low"}, {"min": 25, "feedback": "lower"}]}),
    "none": document([], {}, angles=("a",)),
    "many": document(["a < 5"], {"a": [{"max": 10 * k, "feedback": f"r{k}", "critical": k == 7} for k in range(20, 0, -1)]}),
}


def frames(spark):
    values = [None, NAN, -1e300, 4.999, 5.0, 5.001, 10.0, 20.0, 25.0, 30.0, 40.0, 60.0, 70.5, 71.0, 110.0, 110.5, float("inf")]
    maps = [{"a": x, "b": y, "c": 0.5, "offset": 1.0} for x in values for y in values]
    maps += [{"a": x, "offset": 50.0} for x in values] + [{"b": x, "offset": -45.0} for x in values] + [{}, {"a": 1.0}, {"c": 2.0, "offset": 0.0}]
    rows = [(n, "s", e, level, m, True) for n, m in enumerate(maps) for e in (*DOCUMENTS, "other", None) for level in (0, 1)]
    return spark.createDataFrame(rows, "n int, session_uuid string, exercise string, level int, angles map<string,double>, is_complete boolean")


@pytest.mark.parametrize("stop", [True, False])
def test_tables_equal_the_walk(spark, monkeypatch, stop):
    given = frames(spark)

    def judged():
        catalog = catalog_from_documents(spark, DOCUMENTS)
        tables = catalog.decision_tables(stop)
        found = classify(given, catalog, keep_rejects=True, stop_at_critical=stop).drop("angles").collect()
        return sorted(map(str, found)), [t.state_cells is not None for t in tables], [t.rule_cells is not None for t in tables]

    found, states, cells = judged()
    monkeypatch.setattr(rules, "MAX_CELLS", 0)
    walked, no_states, no_cells = judged()
    assert found == walked and len(found) == given.count()
    assert states.count(False) == 2 and all(cells)  # the sums, at both levels
    assert not any(no_states) and not any(no_cells)


def test_generated_code_for_any_number_of_exercises(spark):
    sound = {k: v for k, v in DOCUMENTS.items() if k != "sums"}
    given = frames(spark).where(F.col("exercise") != "sums")
    one = classify(given, catalog_from_documents(spark, sound))
    more = classify(given, catalog_from_documents(spark, {f"{k}-{n}": v for k, v in sound.items() for n in range(40)}))
    for df in (one, more):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "aggregate(" not in plan
    lines = [df._jdf.queryExecution().optimizedPlan().toString().count("\n") for df in (one, more)]
    assert lines[0] == lines[1]


def test_cells_are_bounded():
    terms = rules.state_terms(["a > 1 and b > 2", " and ".join(f"a > {k}" for k in range(300)), " or ".join(f"b > {k}" for k in range(300))])
    assert rules.DecisionTable(terms, (), True).state_cells is None
    small = rules.DecisionTable(rules.state_terms(["a > 1 and b > 2"]), (), True)
    assert len(small.state_cells) == 25 and small.axes == ["a", "b"] and small.outcomes == [((), False)]
