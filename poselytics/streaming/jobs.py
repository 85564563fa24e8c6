"""Running streams: triggers, sinks, per-batch catalog refresh, changing rules and run metrics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from poselytics.operators.classify import classify, compact_frames
from poselytics.sources.catalog import Catalog, read_catalog

CYCLE = "1 second"


def write_stream(
    df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False
) -> StreamingQuery:
    """Append a stream to files, each second or (``once``) until the input is used up."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=CYCLE)
    return writer.start(path)


def for_each_catalog(
    frames: DataFrame,
    catalog_folder: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    level: int | Column = 0,
    once: bool = False,
) -> StreamingQuery:
    """Classify every micro-batch with the catalog as it is then, and hand it to ``sink``."""

    def classify_batch(batch: DataFrame, batch_id: int) -> None:
        catalog = read_catalog(batch.sparkSession, catalog_folder)
        sink(classify(compact_frames(batch, level), catalog), batch_id)

    writer = frames.writeStream.foreachBatch(classify_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=CYCLE)
    return writer.start()


def judge_stream(
    frames: DataFrame,
    versions: Callable[[SparkSession], Catalog],
    path: str,
    checkpoint: str,
    level: int | Column = 0,
    once: bool = False,
) -> StreamingQuery:
    """Judge every frame by the rules valid at its time, and append it to the Parquet folder ``path``.

    ``versions`` is called again for each micro-batch (with ``catalog.read_catalog_versions`` or
    ``catalog.version_table`` in it), so a new one needs no restart; one that arrives
    after frames of its time were judged does not judge them again. Each micro-batch has its own sub-folder, which a
    repeated run replaces. ``judged_frames`` reads them as a stream, with the rules that sessions are to be folded by.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        catalog = versions(batch.sparkSession)
        compact = compact_frames(batch, level, keep=("timestamp",))
        judged = classify(compact, catalog, keep_rejects=True, limits=True).drop("angles")
        judged.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    writer = frames.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=CYCLE)
    return writer.start()


JUDGED = (
    "session_uuid string, ts_ms bigint, frame_track_uuid string, ts_us bigint, exercise string, level int, "
    "is_complete boolean, timestamp timestamp, bad_posture boolean, state string, feedback_ids array<string>, "
    "critical boolean, success array<string>, inactive_us bigint, reject_reason string"
)


def judged_frames(spark: SparkSession, path: str, delay_s: float, max_files: int | None = None) -> DataFrame:
    """What ``judge_stream`` has written and goes on writing, as a stream for ``sessions.fold_stream``."""
    reader = spark.readStream.schema(JUDGED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path}/batch=*").withWatermark("timestamp", f"{delay_s} seconds")


class RunMetrics(StreamingQueryListener):
    """What each micro-batch of the queries that run meanwhile has processed, rejected and dropped as late.

    ``spark.streams.addListener(metrics)`` starts it; ``metrics.rows`` grows by one record for each progress
    report, and ``metrics.write`` appends those not yet written to a table.
    """

    SCHEMA = T.StructType(
        [
            T.StructField("run_id", T.StringType()),
            T.StructField("batch_id", T.LongType()),
            T.StructField("at", T.StringType()),
            T.StructField("input_rows", T.LongType()),
            T.StructField("frames_processed", T.LongType()),
            T.StructField("frames_rejected", T.LongType()),
            T.StructField("active_sessions", T.LongType()),
            T.StructField("rows_too_late", T.LongType()),
        ]
    )

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.ended: set[str] = set()
        self._written = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get("frames")
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        counts = (seen.frames_processed, seen.frames_rejected, seen.active_sessions) if seen else (0, 0, 0)
        self.rows.append((str(progress.runId), progress.batchId, progress.timestamp, progress.numInputRows, *counts, late))

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait_for(self, run_id: str, seconds: float = 60.0) -> None:
        """Until the end of a query was reported: reports come a little after the fact."""
        until = time.monotonic() + seconds
        while run_id not in self.ended and time.monotonic() < until:
            time.sleep(0.05)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append the new records to the Parquet folder ``path``."""
        new = self.rows[self._written :]
        spark.createDataFrame(new, self.SCHEMA).coalesce(1).write.mode("append").parquet(path)
        self._written += len(new)
