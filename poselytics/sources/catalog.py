"""Exercise catalog: a folder of JSON documents, one per exercise, as small tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from poselytics.functions.rules import DecisionTable, state_terms
from poselytics.schema import CATALOG_DOC

BUILTIN_FOLDER = Path(__file__).resolve().parent.parent / "resources" / "catalog"

# a catalog is configuration: it is read to the driver and broadcast, so its size is checked
MAX_BYTES = 64 << 20

_LEVELS = {"beginner": 0, "pro": 1}

_REQUIRED = [
    "exercise_name",
    "dominant_side_points",
    "landmark_features_dict",
    "angles",
    "state_machine",
    "thresholds",
    "feedback_messages",
]

_STEPS = pa.list_(pa.struct([("op", pa.string()), ("angle", pa.string()), ("value", pa.float64())]))

TERM = pa.struct(
    [
        ("place", pa.int32()),
        ("angle", pa.string()),
        ("value", pa.float64()),
        *[(outcome, pa.int32()) for outcome in ("less", "equal", "greater", "unordered")],
        ("names", pa.list_(pa.string())),
        ("left", _STEPS),
        ("right", _STEPS),
    ]
)

_RULE_ROW = pa.schema(
    {
        "exercise": pa.string(),
        "level": pa.int32(),
        "rules": pa.list_(
            pa.struct(
                {
                    "angle": pa.string(),
                    "min": pa.float64(),
                    "max": pa.float64(),
                    "feedback": pa.string(),
                    "critical": pa.bool_(),
                }
            )
        ),
        "states": pa.list_(pa.string()),
        "terms": pa.list_(TERM),
        "offset_angle": pa.string(),
        "offset_thresh": pa.float64(),
        "success": pa.list_(pa.string()),
        "inactive_us": pa.int64(),
        "valid_from_us": pa.int64(),
        "valid_until_us": pa.int64(),
        "axes": pa.list_(pa.string()),
        "cuts": pa.list_(pa.list_(pa.float64())),
        "state_strides": pa.list_(pa.int32()),
        "state_cells": pa.list_(pa.int32()),
        "rule_strides": pa.list_(pa.int32()),
        "rule_cells": pa.list_(pa.int32()),
        "outcomes": pa.list_(pa.struct({"ids": pa.list_(pa.string()), "critical": pa.bool_()})),
    }
)


@dataclass(frozen=True)
class LevelRules:
    """Everything one exercise asks for at one level."""

    exercise: str
    level: int
    states: tuple[tuple[str, str], ...]
    success_sequence: tuple[str, ...]
    thresholds: tuple[tuple[str, float | None, float | None, str, bool], ...]
    offset_angle: str | None
    offset_thresh: float
    inactive_us: int
    valid_from_us: int | None = None  # None: always
    valid_until_us: int | None = None  # the next version's time


@dataclass
class Catalog:
    """Valid documents and the flat tables derived from them.

    With a column ``valid_from_us`` there may be several versions of a document, each valid until the next
    sound one of its exercise.
    """

    documents: DataFrame
    inactive_override_s: float | None = field(default=None)
    _tables: dict[bool, list[DecisionTable]] = field(default_factory=dict, repr=False)

    def with_inactive_limit(self, seconds: float) -> Catalog:
        return Catalog(self.documents, seconds)

    @property
    def versioned(self) -> bool:
        return "valid_from_us" in self.documents.columns

    @property
    def state_rules(self) -> DataFrame:
        return (
            self.documents.select("exercise", F.explode("doc.state_machine").alias("level_name", "m"))
            .select("exercise", _level(), F.posexplode("m.states").alias("seq", "s"))
            .select("exercise", "level", "seq", F.col("s.id").alias("state_id"), "s.condition")
        )

    @property
    def success_sequences(self) -> DataFrame:
        return self.documents.select(
            "exercise", F.explode("doc.state_machine").alias("level_name", "m")
        ).select("exercise", _level(), F.col("m.success_sequence").alias("success_sequence"))

    @property
    def threshold_rules(self) -> DataFrame:
        return (
            self.documents.select("exercise", F.explode("doc.thresholds").alias("level_name", "t"))
            .select("exercise", _level(), F.posexplode("t.angle_thresh").alias("angle_seq", "angle", "rules"))
            .select("*", F.posexplode("rules").alias("rule_seq", "r"))
            .select(
                "exercise",
                "level",
                "angle_seq",
                "rule_seq",
                "angle",
                "r.min",
                "r.max",
                "r.feedback",
                F.coalesce("r.critical", F.lit(False)).alias("critical"),
            )
        )

    @property
    def limits(self) -> DataFrame:
        offset_names = F.filter(
            F.transform("doc.angles", lambda a: a["name"]), lambda n: n.contains("offset")
        )
        return (
            self.documents.select(
                "exercise",
                F.get(offset_names, F.lit(0)).alias("offset_angle"),
                F.explode("doc.thresholds").alias("level_name", "t"),
            )
            .select(
                "exercise",
                _level(),
                "offset_angle",
                F.col("t.OFFSET_THRESH").alias("offset_thresh"),
                F.col("t.INACTIVE_THRESH").alias("inactive_thresh"),
            )
        )

    @property
    def feedback_messages(self) -> DataFrame:
        """Message dimension; of two messages with one id the later one counts."""
        return (
            self.documents.select("exercise", F.posexplode("doc.feedback_messages").alias("pos", "m"))
            .groupBy("exercise", F.col("m.id").alias("id"))
            .agg(F.max_by("m", "pos").alias("m"))
            .select("exercise", "id", "m.message", "m.severity", "m.color")
        )

    @cached_property
    def n_bytes(self) -> int:
        """Size of the documents as JSON."""
        return self.documents.agg(F.sum(F.octet_length(F.to_json("doc"))).alias("n")).first()["n"] or 0

    @property
    def rules(self) -> list[LevelRules]:
        """Rules per (exercise, level) of the documents that are sound."""
        return self._read[0]

    @property
    def invalid(self) -> dict[str, str]:
        """Reason for each document whose rules cannot be used; its exercise counts as unknown."""
        return self._read[1]

    @cached_property
    def _read(self) -> tuple[list[LevelRules], dict[str, str]]:
        """Rules and reasons, read to the driver behind a size check."""
        if self.n_bytes > MAX_BYTES:
            raise ValueError(f"catalog has more than {MAX_BYTES} bytes")
        rules: list[LevelRules] = []
        invalid: dict[str, str] = {}
        open_until: dict[tuple[str, int], int] = {}
        since = (lambda d: d.valid_from_us) if self.versioned else (lambda d: None)
        # latest version first, so that each one's end is known
        for row in sorted(self.documents.collect(), key=lambda d: (d.exercise, -(since(d) or 0))):
            try:
                found = self._levels(row.exercise, row.doc)
            except _BadDocument as error:
                name = f"{row.exercise}@{since(row)}" if self.versioned else row.exercise
                invalid[name] = str(error)
                continue
            for level in found:
                key = (level.exercise, level.level)
                rules.append(replace(level, valid_from_us=since(row), valid_until_us=open_until.get(key)))
                if self.versioned:
                    open_until[key] = since(row)
        return rules, invalid

    def _levels(self, exercise: str, doc: Row) -> list[LevelRules]:
        names = [a and a.name for a in doc.angles]
        if None in names:
            raise _BadDocument("an angle has no name")
        offset = next((n for n in names if "offset" in n), None)
        found = []
        for name, level in _LEVELS.items():
            machine, limits = doc.state_machine.get(name), doc.thresholds.get(name)
            # a level needs both its state machine and its thresholds
            if machine is None or limits is None or not machine.success_sequence:
                continue
            seconds = limits.INACTIVE_THRESH if self.inactive_override_s is None else self.inactive_override_s
            if seconds is None:
                raise _BadDocument(f"{name}: INACTIVE_THRESH is missing")
            if offset is not None and limits.OFFSET_THRESH is None:
                raise _BadDocument(f"{name}: OFFSET_THRESH is missing")
            found.append(
                LevelRules(
                    exercise,
                    level,
                    tuple(_state(name, s) for s in machine.states or []),
                    tuple(machine.success_sequence),
                    tuple(
                        _threshold(name, angle, t)
                        for angle, rules in (limits.angle_thresh or {}).items()
                        for t in rules or []
                    ),
                    offset,
                    limits.OFFSET_THRESH,
                    round(seconds * 1_000_000),
                )
            )
        return found

    def decision_tables(self, stop_at_critical: bool = True) -> list[DecisionTable]:
        """One for each of ``rules``."""
        if stop_at_critical not in self._tables:
            self._tables[stop_at_critical] = [
                DecisionTable(state_terms([text for _, text in r.states]), r.thresholds, stop_at_critical) for r in self.rules
            ]
        return self._tables[stop_at_critical]

    def rule_table(self, stop_at_critical: bool = True) -> DataFrame:
        """One row per (exercise, level), small enough to broadcast."""
        rows = [
            {
                "exercise": r.exercise,
                "level": r.level,
                "rules": [dict(zip(("angle", "min", "max", "feedback", "critical"), t)) for t in r.thresholds],
                "states": [state for state, _ in r.states],
                "terms": state_terms([text for _, text in r.states]),
                "offset_angle": r.offset_angle,
                "offset_thresh": r.offset_thresh,
                "success": list(r.success_sequence),
                "inactive_us": r.inactive_us,
                "valid_from_us": r.valid_from_us,
                "valid_until_us": r.valid_until_us,
                "axes": table.axes,
                "cuts": table.cuts,
                "state_strides": table.state_strides,
                "state_cells": table.state_cells,
                "rule_strides": table.rule_strides,
                "rule_cells": table.rule_cells,
                "outcomes": [{"ids": list(ids), "critical": critical} for ids, critical in table.outcomes],
            }
            for r, table in zip(self.rules, self.decision_tables(stop_at_critical), strict=True)
        ]
        return self.documents.sparkSession.createDataFrame(pa.Table.from_pylist(rows, _RULE_ROW))


class _BadDocument(Exception):
    """Why a document's rules cannot be used."""


def _state(level: str, state: Row | None) -> tuple[str, str]:
    if state is None or state.id is None or state.condition is None:
        raise _BadDocument(f"{level}: a state lacks its id or condition")
    try:
        state_terms([state.condition])
    except (ValueError, SyntaxError) as error:
        raise _BadDocument(f"{level}: {error}") from error
    return state.id, state.condition


def _threshold(level: str, angle: str, rule: Row | None) -> tuple[str, float | None, float | None, str, bool]:
    if rule is None or rule.feedback is None:
        raise _BadDocument(f"{level}: a rule of {angle} has no feedback")
    return angle, rule.min, rule.max, rule.feedback, bool(rule.critical)


def _level() -> object:
    level = F.lit(None).cast("int")
    for name, number in _LEVELS.items():
        level = F.when(F.col("level_name") == name, F.lit(number)).otherwise(level)
    return level.alias("level")


def _validated(raw: DataFrame, *keys_too: str) -> DataFrame:
    """Keep documents that satisfy the schema; an invalid file is an absent exercise."""
    doc = F.from_json("text", CATALOG_DOC)
    keys = F.json_object_keys("text")
    valid = F.array_contains("keys", "inactivity_time")
    for name in _REQUIRED:
        valid = valid & F.col(f"doc.{name}").isNotNull()
    valid = valid & ~F.exists(
        "doc.feedback_messages", lambda m: m["id"].isNull() | m["message"].isNull()
    )
    return (
        raw.select("exercise", *keys_too, doc.alias("doc"), keys.alias("keys"))
        .filter(F.coalesce(valid, F.lit(False)))
        .select("exercise", *keys_too, "doc")
    )


def read_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Scan ``folder`` for ``*.json``; the exercise key is the file stem."""
    raw = (
        spark.read.option("pathGlobFilter", "*.json")
        .text(folder, wholetext=True)
        .select(
            F.regexp_replace("_metadata.file_name", r"\.json", "").alias("exercise"),
            F.col("value").alias("text"),
        )
    )
    return Catalog(_validated(raw))


def read_catalog_versions(spark: SparkSession, folder: str) -> Catalog:
    """Scan ``folder/valid_from=<time>/*.json``: what each document says from that time (UTC, ISO-8601) on."""
    raw = (
        spark.read.option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", "true")
        .text(folder, wholetext=True)
        .select(
            F.regexp_replace("_metadata.file_name", r"\.json", "").alias("exercise"),
            F.unix_micros(
                F.try_to_timestamp(F.url_decode(F.regexp_extract("_metadata.file_path", "/valid_from=([^/]+)/[^/]*$", 1)))
            ).alias("valid_from_us"),
            F.col("value").alias("text"),
        )
        .filter(F.col("valid_from_us").isNotNull())
    )
    return Catalog(_validated(raw, "valid_from_us"))


def version_table(spark: SparkSession, path: str) -> Catalog:
    """Versions from a table (Parquet) with the columns ``exercise``, ``valid_from`` (timestamp) and ``text``."""
    raw = spark.read.schema("exercise string, valid_from timestamp, text string").parquet(path)
    raw = raw.select("exercise", F.unix_micros("valid_from").alias("valid_from_us"), "text")
    return Catalog(_validated(raw.filter("valid_from_us IS NOT NULL"), "valid_from_us"))


def catalog_from_documents(spark: SparkSession, documents: dict[str, str]) -> Catalog:
    """Catalog from documents already in hand (``exercise -> JSON text``)."""
    raw = spark.createDataFrame(
        pa.table({"exercise": list(documents), "text": list(documents.values())})
    )
    return Catalog(_validated(raw))


def builtin_catalog(spark: SparkSession) -> Catalog:
    """The catalog shipped with the package; read on the driver, so no shared path is needed."""
    return catalog_from_documents(
        spark, {p.stem: p.read_text(encoding="utf-8") for p in sorted(BUILTIN_FOLDER.glob("*.json"))}
    )


def write_documents(spark: SparkSession, folder: str, documents: dict[str, str]) -> None:
    """Store documents as ``<exercise>.json`` in a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    for name, text in documents.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()


def message_for(catalog: Catalog, exercise: str, feedback_id: str) -> DataFrame:
    """The one message of an exercise with the given id (no row if there is none)."""
    return catalog.feedback_messages.filter(
        (F.col("exercise") == exercise) & (F.col("id") == feedback_id)
    )
