"""Stateless frame work: posture, movement state and threshold violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poselytics.functions.angles import angle_map, nan_to_null
from poselytics.functions.rules import (
    NO_STATE,
    cell_steps,
    first_state_sql,
    up_to_first_critical,
    violated_rules,
)
from poselytics.sources.catalog import MAX_BYTES, Catalog

# replay order inside a session: epoch ms, ties by frame id, then full precision
ORDER = ["ts_ms", "frame_track_uuid", "ts_us"]

COMPLETION_TOLERANCE_S = 0.1


def order_key() -> Column:
    return F.struct(*ORDER)


def compact_frames(
    frames: DataFrame, level: int | Column = 0, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The few columns the analysis reads; landmarks are never touched.

    ``level`` is 0 for beginner, anything else for pro. ``keep`` names further
    columns to carry along.
    """
    level = F.lit(level) if isinstance(level, int) else level
    complete = F.col("current_time") >= F.col("video_duration") - F.lit(COMPLETION_TOLERANCE_S)
    # NaN sorts above every number in Spark, yet completes nothing
    complete = complete & ~F.isnan("current_time") & ~F.isnan("video_duration")
    instant = F.col("timestamp").cast("timestamp")
    return frames.select(
        "session_uuid",
        F.unix_millis(instant).alias("ts_ms"),
        "frame_track_uuid",
        F.unix_micros(instant).alias("ts_us"),
        "exercise",
        F.when(level != 0, F.lit(1)).otherwise(F.lit(0)).alias("level"),
        angle_map(F.col("metrics.angles")).alias("angles"),
        F.coalesce(complete, F.lit(False)).alias("is_complete"),
        *keep,
    )


def classify(
    compact: DataFrame,
    catalog: Catalog,
    exercise: str = "exercise",
    keep_rejects: bool = False,
    stop_at_critical: bool = True,
    limits: bool = False,
) -> DataFrame:
    """Add ``bad_posture, state, feedback_ids, critical``; one narrow pass, no shuffle.

    ``exercise`` names the column that picks the rules. Frames of an unknown
    exercise, or without an angle that a rule comes to read, are dropped; with
    ``keep_rejects`` they stay, marked by ``reject_reason``. ``limits`` adds ``success`` and
    ``inactive_us``, the sequence and limit a fold goes by. Of a catalog with versions, the one valid at the frame's time judges it.

    The rules are data: one row per exercise and level, broadcast (the catalog's size is
    checked on reading). It holds a decision table: a frame takes a binary search per angle and a lookup, all in generated
    code. Only if a catalog has conditions that no table holds, such as sums of angles, are the comparisons of
    those exercises walked one by one.
    """
    tables = catalog.decision_tables(stop_at_critical)
    walk_states = any(t.state_cells is None for t in tables)
    walk_rules = any(t.rule_cells is None for t in tables)
    table = catalog.rule_table(stop_at_critical)
    unused = [c for c, needed in (("terms", walk_states), ("rules", walk_rules)) if not needed]
    rules = F.broadcast(table.select(*[F.col(c).alias(f"_{c}") for c in table.columns if c not in unused]))
    match = (F.col(exercise) == F.col("_exercise")) & (F.col("level") == F.col("_level"))
    if catalog.versioned:
        match = match & F.expr("ts_us >= _valid_from_us AND (_valid_until_us IS NULL OR ts_us < _valid_until_us)")
    judged = compact.join(rules, match, "left")
    for step in cell_steps(
        max((len(t.axes) for t in tables), default=0), max((len(c) for t in tables for c in t.cuts), default=0), "angles"
    ):
        judged = judged.selectExpr("*", *step)
    bad = "coalesce(abs(nanvl(angles[_offset_angle], NULL)) > _offset_thresh, false)"
    readable = "(_offset_angle IS NULL OR coalesce(map_contains_key(angles, _offset_angle), false))"
    at = "get(_state_cells, _state_cell)"
    if walk_states:
        at = f"CASE WHEN _state_cells IS NOT NULL THEN {at} ELSE {first_state_sql('_terms', 'angles')} END"
    at = f"CASE WHEN NOT {bad} AND {readable} THEN {at} END"
    # a generator row: a filter on the outcome cannot be moved below it, where it would evaluate everything again
    judged = judged.selectExpr("*", f"inline(array(struct({bad} AS bad_posture, {at} AS _at, get(_rule_cells, _rule_cell) AS _outcome)))")
    judged = judged.selectExpr("*", f"{_REJECT_REASON} AS reject_reason")
    judged = judged.selectExpr("*", f"CASE WHEN _at < {NO_STATE} THEN get(_states, {NO_STATE - 1} - _at) END AS state")
    applies = "NOT bad_posture AND reject_reason IS NULL AND NOT (state <=> 's1')"
    ids, critical = "get(_outcomes, _outcome).ids", "get(_outcomes, _outcome).critical"
    if walk_rules:
        violated = violated_rules(F.col("_rules"), F.col("angles"))
        if stop_at_critical:
            violated = up_to_first_critical(violated)
        judged = judged.withColumn("_violated", F.when(F.expr(f"{applies} AND _rule_cells IS NULL"), violated))
        ids = f"coalesce(transform(_violated, r -> r.feedback), {ids})"
        critical = f"coalesce(exists(_violated, r -> r.critical), {critical})"
    result = judged.selectExpr(
        *[f"`{c}`" for c in compact.columns],
        "bad_posture",
        "state",
        f"coalesce(CASE WHEN {applies} THEN {ids} END, CAST(array() AS ARRAY<STRING>)) AS feedback_ids",
        f"coalesce({applies} AND {critical}, false) AS critical",
        *(["_success AS success", "_inactive_us AS inactive_us"] if limits else []),
        "reject_reason",
    )
    if keep_rejects:
        return result
    return result.filter(F.col("reject_reason").isNull()).drop("reject_reason")


_REJECT_REASON = (
    "CASE WHEN _exercise IS NULL THEN 'unknown_exercise' WHEN NOT bad_posture AND _at IS NULL THEN 'missing_angle' END"
)


def rule_rejects(compact: DataFrame, catalog: Catalog) -> DataFrame:
    """Frames the rules cannot judge, with ``reject_reason``."""
    judged = classify(compact, catalog, keep_rejects=True)
    return judged.filter(F.col("reject_reason").isNotNull()).select(
        "session_uuid", "frame_track_uuid", "exercise", "reject_reason"
    )


def frame_angles(compact: DataFrame) -> DataFrame:
    """One row per frame and angle name (NaN shown as NULL)."""
    return compact.select(
        "session_uuid", "frame_track_uuid", F.explode("angles").alias("angle", "value")
    ).withColumn("value", nan_to_null(F.col("value")))


def session_exercise(compact: DataFrame) -> DataFrame:
    """Exercise of each session's first frame; partially aggregated before the shuffle."""
    return compact.groupBy("session_uuid").agg(
        F.min_by("exercise", order_key()).alias("session_exercise")
    )


def frame_violations(classified: DataFrame) -> DataFrame:
    """One row per frame and feedback occurrence, in rule order."""
    return classified.select(
        "session_uuid",
        "frame_track_uuid",
        F.posexplode("feedback_ids").alias("seq", "feedback_id"),
        "exercise",
    )


def with_messages(violations: DataFrame, catalog: Catalog) -> DataFrame:
    """Attach message text and severity; unknown ids keep NULLs."""
    messages = catalog.feedback_messages.withColumnRenamed("id", "feedback_id")
    if catalog.n_bytes <= MAX_BYTES:
        messages = F.broadcast(messages)
    return violations.join(messages, ["exercise", "feedback_id"], "left")
