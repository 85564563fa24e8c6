"""Feedback log, data-anchored feedback windows and their session summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poselytics.operators.session_fold import KEYS, WINDOW_S

MIN_FRAME_RATIO = 0.6
MAIN_ISSUE_RATIO = 0.7
OCCASIONAL_ISSUE_RATIO = 0.3

# feedback ids of one frame: places within a frame fit below this
MAX_FRAME_IDS = 1 << 20


def frame_feedback(trace: DataFrame) -> DataFrame:
    """Feedback ids per good-posture frame, empty lists included."""
    return trace.filter(~F.col("bad_posture")).select(
        "session_uuid", "session_instance", "ts_us", "frame_track_uuid", "feedback_ids"
    )


def window_counts(trace: DataFrame) -> DataFrame:
    """Occurrences per window and id, plus a row with a NULL id where the window was closed.

    A closing frame anchors the next window and is counted in neither. Counts are
    partially aggregated before the shuffle, whatever the size of the window.
    """
    entry = "struct<window_us:bigint,feedback_id:string,seq:int>"
    counted = F.transform(
        "feedback_ids",
        lambda id_, i: F.struct(
            F.col("window_us").alias("window_us"), id_.alias("feedback_id"), i.alias("seq")
        ).cast(entry),
    )
    closing = F.array(
        F.struct(
            F.col("closed_window_us").alias("window_us"),
            F.lit(None).cast("string").alias("feedback_id"),
            F.lit(0).alias("seq"),
        ).cast(entry)
    )
    entries = F.when(F.col("closed_window_us").isNotNull(), closing).when(
        F.col("window_us").isNotNull(), counted
    )
    return (
        trace.select(*KEYS, "frame_no", F.explode(entries).alias("e"))
        .groupBy(*KEYS, "e.window_us", "e.feedback_id")
        .agg(
            F.count("*").alias("count"),
            F.min(F.col("frame_no") * F.lit(MAX_FRAME_IDS) + F.col("e.seq")).alias("first_seen"),
        )
    )


def feedback_windows(
    trace: DataFrame,
    window_s: float = WINDOW_S,
    min_frame_ratio: float = MIN_FRAME_RATIO,
    flush_open: bool = False,
) -> DataFrame:
    """Closed windows with at least one occurrence; ids below the share are removed.

    ``frame_ratio`` is an id's share of all occurrences in the window. A window
    whose ids all fall short is kept with an empty list. The last, still open
    window is left out unless ``flush_open``.
    """
    is_closer = F.col("feedback_id").isNull()
    # one entry per feedback id of the exercise: as small as its rule list
    seen = F.array_sort(
        F.collect_list(F.when(~is_closer, F.struct("first_seen", "feedback_id", "count")))
    )
    per_window = (
        window_counts(trace)
        .groupBy(*KEYS, F.col("window_us").alias("start_us"))
        .agg(
            F.bool_or(is_closer).alias("is_closed"),
            F.sum(F.when(~is_closer, F.col("count"))).alias("total"),
            seen.alias("seen"),
        )
        .filter(F.col("total") > 0)
    )
    if not flush_open:
        per_window = per_window.filter("is_closed")
    shares = F.transform(
        "seen",
        lambda s: F.struct(
            s["feedback_id"].alias("id"),
            s["count"].alias("count"),
            (s["count"] / F.col("total")).alias("frame_ratio"),
        ),
    )
    return per_window.select(
        *KEYS,
        "start_us",
        (F.col("start_us") + F.lit(round(window_s * 1_000_000))).alias("end_us"),
        F.filter(shares, lambda s: s["frame_ratio"] >= min_frame_ratio).alias("feedback"),
    )


def feedback_summary(windows: DataFrame) -> DataFrame:
    """Per session and id: windows it persisted in, occurrences, share of all windows."""
    # a NULL id counts every window once, so one aggregation yields both counts
    each = F.transform(
        "feedback",
        lambda f, i: F.struct(f["id"].alias("id"), f["count"].alias("count"), i.alias("seq")),
    )
    every = F.array(
        F.struct(
            F.lit(None).cast("string").alias("id"),
            F.lit(0).cast("bigint").alias("count"),
            F.lit(0).alias("seq"),
        )
    )
    per_id = (
        windows.select(*KEYS, "start_us", F.explode(F.concat(every, each)).alias("f"))
        .groupBy(*KEYS, F.col("f.id").alias("feedback_id"))
        .agg(
            F.count("*").alias("windows_count"),
            F.sum("f.count").alias("total_occurrences"),
            F.min(F.struct("start_us", "f.seq")).alias("first_seen"),
        )
    )
    # one row per id of the exercise plus one: a small partition
    total = F.max(F.when(F.col("feedback_id").isNull(), F.col("windows_count"))).over(
        Window.partitionBy(*KEYS)
    )
    return (
        per_id.withColumn("total_windows", total)
        .filter(F.col("feedback_id").isNotNull())
        .select(
            *KEYS,
            "feedback_id",
            "windows_count",
            "total_occurrences",
            (F.col("windows_count") / F.col("total_windows")).alias("window_ratio"),
            "first_seen",
        )
    )


def issue_tier(window_ratio: Column) -> Column:
    return F.when(window_ratio >= MAIN_ISSUE_RATIO, F.lit("main")).when(
        window_ratio >= OCCASIONAL_ISSUE_RATIO, F.lit("occasional")
    )


def issue_tiers(summary: DataFrame) -> DataFrame:
    """Ids that persisted in most windows (main) or in several (occasional)."""
    return (
        summary.select(*KEYS, "feedback_id", "window_ratio", issue_tier(F.col("window_ratio")).alias("tier"))
        .filter(F.col("tier").isNotNull())
    )


def exercise_summary(states: DataFrame, windows: DataFrame) -> DataFrame:
    """One nested row per session instance.

    Windows are at least ``window_s`` of event time apart, so the list grows with
    the length of the session in time, not with its number of frames. Sessions
    without windows keep their counts, with empty lists and no duration.
    """
    per_session = windows.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("start_us", "end_us", "feedback"))).alias("windows")
    )
    empty = F.array().cast(per_session.schema["windows"].dataType)
    total = F.size("windows").cast("bigint")
    span = F.element_at("windows", -1)["end_us"] - F.element_at("windows", 1)["start_us"]
    return (
        states.join(per_session, KEYS, "left")
        .withColumn("windows", F.coalesce("windows", empty))
        .withColumn("total_windows", total)
        .withColumn("feedback_summary", _issues(F.col("windows"), total))
        .withColumn("exercise_duration", F.when(total > 0, span / F.lit(1e6)))
    )


def _issues(windows: Column, total: Column) -> Column:
    """:func:`feedback_summary` of one session's ordered windows, ids in order of appearance."""
    found = F.flatten(F.transform(windows, lambda w: w["feedback"]))

    def issue(found: Column, id_: Column) -> Column:
        mine = F.filter(found, lambda f: f["id"] == id_)
        count = F.size(mine).cast("bigint")
        return F.struct(
            id_.alias("id"),
            count.alias("windows_count"),
            F.aggregate(mine, F.lit(0).cast("bigint"), lambda n, f: n + f["count"]).alias("total_occurrences"),
            (count / total).alias("window_ratio"),
        )

    def issues(found: Column) -> Column:
        ids = F.array_distinct(F.transform(found, lambda f: f["id"]))
        return F.transform(ids, lambda id_: issue(found, id_))

    # the list is bound as a lambda variable, so it is built once
    return F.transform(F.array(found), issues)[0]
