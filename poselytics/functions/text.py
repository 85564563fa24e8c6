"""Text rendering of session summaries, and the model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from poselytics.schema import ANALYSIS


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed-point text of a double of at most 10^15, with one or two digits.

    The exact binary value is rounded, so 0.615, which lies just below the tie, gives 0.61; true ties
    go to the even digit. The fraction is taken in units of 2^-60: it has no finer bits
    unless it is too small to reach the first tie.
    """
    scale = 10**digits
    size = F.abs(value)
    whole = F.floor(size)
    fraction = ((size - whole) * F.lit(float(1 << 60))).cast("long")

    # times 10^digits in two halves of 30 bits: low are the digits to keep, rest is cut off
    bits = F.lit((1 << 30) - 1)
    lower = fraction.bitwiseAND(bits) * F.lit(scale)
    upper = F.shiftright(fraction, 30) * F.lit(scale) + F.shiftright(lower, 30)
    low = F.shiftright(upper, 30)
    rest = F.shiftleft(upper.bitwiseAND(bits), 30) + lower.bitwiseAND(bits)
    tie = F.lit(1 << 59)
    kept = low + ((rest > tie) | ((rest == tie) & (low % 2 == 1))).cast("long")
    text = F.concat(
        (whole + (kept == scale).cast("long")).cast("string"),
        F.lit("."),
        F.lpad((kept % F.lit(scale)).cast("string"), digits, "0"),
    )
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def timeline_text(windows: Column) -> Column:
    """A paragraph per window that kept an id, with a line per id; times in seconds."""

    def paragraph(w: Column) -> Column:
        lines = F.transform(
            w["feedback"],
            lambda f: F.concat(
                F.lit("- "), f["id"], F.lit(" (persistence: "), fixed_text(f["frame_ratio"], 2), F.lit(")")
            ),
        )
        return F.concat(
            F.lit("Time "),
            fixed_text(w["start_us"] / F.lit(1e6), 1),
            F.lit("-"),
            fixed_text(w["end_us"] / F.lit(1e6), 1),
            F.lit("s:\n"),
            F.array_join(lines, "\n"),
        )

    kept = F.filter(windows, lambda w: F.size(w["feedback"]) > 0)
    return F.array_join(F.transform(kept, paragraph), "\n\n")


def summary_text(issues: Column) -> Column:
    """One line per feedback id with the share of windows it persisted in."""
    return F.array_join(
        F.transform(
            issues,
            lambda i: F.concat(
                F.lit("- "),
                i["id"],
                F.lit(": occurred in "),
                fixed_text(i["window_ratio"] * F.lit(100.0), 1),
                F.lit("% of exercise time"),
            ),
        ),
        "\n",
    )


_REPLY_FORM = (
    "Reply with one JSON object holding: "
    "safety_analysis (status: safe, warning or dangerous; risk_level: 1-10; critical_corrections: list), "
    "performance_analysis (quality_score: 1-10; main_issues: list of issue, severity, description; "
    "progress_evaluation), "
    "recommendations (critical_corrections, improvement_suggestions, future_session_tips: lists) "
    "and reasoning."
)


def prompt_text(exercise: Column, duration_s: Column, correct: Column, incorrect: Column, timeline: Column, summary: Column) -> Column:
    """Prompt for a trainer-style analysis; NULL where the session has no duration."""
    return F.concat(
        F.lit("You are a professional trainer. Review this "),
        exercise,
        F.lit(" session for safety and efficiency.\n\nDuration: "),
        duration_s.cast("string"),
        F.lit(" seconds\nCorrect repetitions: "),
        correct.cast("string"),
        F.lit("\nIncorrect repetitions: "),
        incorrect.cast("string"),
        F.lit("\n\nTimeline of issues:\n"),
        timeline,
        F.lit("\n\nFeedback summary:\n"),
        summary,
        F.lit(
            "\n\nConsider dangerous combinations of issues, the risk of injury, crucial corrections, "
            "progress during the session, advice for later sessions and overall quality.\n" + _REPLY_FORM
        ),
    )


def with_texts(summaries: DataFrame) -> DataFrame:
    """Add ``timeline``, ``summary_text`` and ``prompt`` to session summaries."""
    return (
        summaries.withColumn("timeline", timeline_text(F.col("windows")))
        .withColumn("summary_text", summary_text(F.col("feedback_summary")))
        .withColumn(
            "prompt",
            prompt_text(
                F.col("last_exercise"),
                F.col("exercise_duration"),
                F.col("correct"),
                F.col("incorrect"),
                F.col("timeline"),
                F.col("summary_text"),
            ),
        )
    )


def score_prompts(
    df: DataFrame,
    scorer: Callable[[pd.Series, str], pd.Series] | None,
    language: str = "ru",
    prompt: str = "prompt",
) -> DataFrame:
    """Add ``reply``: a caller-supplied batch function over the prompts.

    Without a scorer the frame is returned as it is. Rows without a prompt get
    NULL, and so do those whose prompt fails when it is asked by itself.
    """
    if scorer is None:
        return df
    schema = StructType(list(df.schema.fields)).add("reply", StringType())

    def alone(one: pd.Series) -> str | None:
        try:
            return list(scorer(one, language))[0]
        except Exception as error:  # noqa: BLE001
            print(f"scorer failed on a prompt: {error}")
            return None

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["reply"] = None
            asked = batch[prompt].notna()
            if asked.any():
                prompts = batch.loc[asked, prompt]
                try:
                    replies = list(scorer(prompts, language))
                except Exception:  # noqa: BLE001 - a failing model must not fail the job
                    # one prompt may be to blame, so each is asked by itself
                    replies = [alone(prompts.iloc[[k]]) for k in range(len(prompts))]
                batch.loc[asked, "reply"] = replies
            yield batch

    return df.mapInPandas(score, schema)


def parse_analysis(reply: Column) -> Column:
    """Structured reply; NULL where the text is no such object."""
    parsed = F.from_json(reply, ANALYSIS)
    return F.when(F.json_object_keys(reply).isNotNull(), parsed)
